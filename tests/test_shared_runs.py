from __future__ import annotations

import random

from test_matching import make_bench, make_train

from evalsieve.operators import ngrams, shared_runs


def plain_longest(row, item, n):
    """Longest common run of at least n tokens: length, place in the row, place in the item."""
    a, b = row.lower().split(), item.lower().split()
    best = None
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k >= n and (best is None or (k, -i, -j) > best):
                best = (k, -i, -j)
    return best and (best[0], -best[1], -best[2])


def expected(texts, items, n):
    found = set()
    for benchmark, own in items.items():
        for j, item in enumerate(own):
            for i, text in enumerate(texts):
                run = plain_longest(text, item, n)
                if run:
                    found.add((benchmark, j, i, run[2], run[1], run[0]))
    return found


def test_longest_runs_by_brute_force(spark, all_sizes):
    draw = random.Random(13)
    vocabulary = "a b c d".split()
    items = {b: [" ".join(draw.choices(vocabulary, k=draw.randint(5, 30))) for _ in range(6)] for b in ("one", "two")}
    pool = [i for own in items.values() for i in own]
    texts = []
    for _ in range(40):
        cut = draw.choice(pool).split()
        a = draw.randrange(len(cut))
        texts.append(" ".join(draw.choices(vocabulary, k=draw.randint(0, 12)) + cut[a : a + draw.randint(4, 20)] + draw.choices(vocabulary, k=5)))
    texts += ["a " * 40, "", pool[0], pool[0] + " " + pool[0], texts[0], texts[0]]
    items["one"].append("a " * 25)
    found = shared_runs.longest_runs(make_train(spark, texts), make_bench(spark, items), n=5)
    assert {tuple(r) for r in found.collect()} == expected(texts, items, 5)


def test_runs_of_all_pairs_and_of_none(spark):
    texts = ["the closing phrase is the same in every row of this set here " + str(i) for i in range(30)]
    items = {"b": ["find it where the closing phrase is the same in every row of this set here", "short one"]}
    train, bench = make_train(spark, texts), make_bench(spark, items)
    found = shared_runs.longest_runs(train, bench, n=8).collect()
    assert {(r.train_idx, r.length, r.train_start, r.test_start) for r in found} == {(i, 13, 0, 3) for i in range(30)}
    pairs = ngrams.contamination_matches(train, bench, n=8)
    assert pairs.count() == len(found)
    assert shared_runs.longest_runs(train.limit(0), bench, n=8).count() == 0
    assert shared_runs.longest_runs(train, bench.limit(0), n=8).count() == 0


def test_rows_with_one_stretch_meet_the_items_once(spark):
    texts = [f"{i} one phrase of eight words for many rows {i}" for i in range(50)]
    dictionary = ngrams.bench_ngrams(make_bench(spark, {"b": ["one phrase of eight words for many rows"]}), 8)
    hits = ngrams.train_hits(make_train(spark, texts), dictionary.select("benchmark", "n", "ngram")).withColumnRenamed("row_idx", "train_idx")
    found = shared_runs.stretches(hits)
    assert found.count() == 50 and found.select("words").distinct().count() == 1
