from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from evalsieve import (
    contaminated_indices,
    contamination_matches,
    contamination_summary,
    contamination_total,
    detect,
    match_details,
    match_sources,
    ngram_length,
    ngram_matches,
)
from evalsieve.functions.text import words

SEED = 11
TRAIN = "row_idx long, id string, prompt string, source string"
BENCH = "benchmark string, test_idx long, id string, prompt string"


def make_train(spark, texts, sources=None):
    rows = [(i, f"t{i}", t, sources[i] if sources else "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, TRAIN)


def make_bench(spark, items):
    rows = [(b, i, f"{b}-{i}", t) for b, texts in items.items() for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BENCH)


def grams(text, n):
    t = text.lower().split()
    return {(i, tuple(t[i : i + n])) for i in range(len(t) - n + 1)}


def brute_pairs(train, items, lengths):
    return {
        (b, i, j)
        for b, texts in items.items()
        for i, q in enumerate(texts)
        for j, d in enumerate(train)
        if {g for _, g in grams(q, lengths[b])} & {g for _, g in grams(d, lengths[b])}
    }


def corpus():
    """Few words, so that runs repeat; some items are planted in training texts."""
    rng = random.Random(SEED)

    def text(lo, hi):
        return " ".join(rng.choices(["a", "B", "c", "d."], k=rng.randint(lo, hi)))

    items = {"one": [text(6, 20) for _ in range(25)], "two": [text(14, 40) for _ in range(15)]}
    train = [text(0, 60) for _ in range(120)]
    for i in range(0, 60, 3):
        source = rng.choice(items["one"] + items["two"])
        train[i] += "\n" + source.upper() + "  " + text(0, 9)
    train += ["", "   ", train[0], train[0]]
    return train, items


def percentile_n(texts):
    sizes = sorted(len(t.split()) for t in texts)
    at = 0.05 * (len(sizes) - 1)
    low = sizes[int(at)]
    high = sizes[min(int(at) + 1, len(sizes) - 1)]
    return max(8, min(13, int(low + (high - low) * (at - int(at)))))


def test_lengths_are_per_benchmark(spark):
    _, items = corpus()
    found = {r["benchmark"]: r["n"] for r in ngram_length(make_bench(spark, items)).collect()}
    assert found == {b: percentile_n(t) for b, t in items.items()}
    assert found["one"] == 8 and found["two"] == 13


def test_pairs_match_brute_force(spark, all_sizes):
    train, items = corpus()
    lengths = {b: percentile_n(t) for b, t in items.items()}
    found = contamination_matches(make_train(spark, train), make_bench(spark, items))
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    want = brute_pairs(train, items, lengths)
    assert set(pairs) == want and len(want) > 20


@pytest.mark.parametrize("n", [1, 3, 4, 5, 13])
def test_given_length(spark, all_sizes, n):
    rng = random.Random(SEED)
    train = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))) for _ in range(40)]
    items = {"x": [" ".join(rng.choices("abcdefghi", k=rng.randint(0, 9))) for _ in range(12)]}
    items["x"].append(" ".join(train[3].split()[:20]))
    found = contamination_matches(make_train(spark, train), make_bench(spark, items), n=n)
    assert {tuple(r) for r in found.collect()} == brute_pairs(train, items, {"x": n})


def test_positions_match_brute_force(spark, all_sizes):
    train, items = corpus()
    found = ngram_matches(make_train(spark, train), make_bench(spark, items), n=9)
    want = {
        (b, i, " ".join(g), p, j, q)
        for b, texts in items.items()
        for i, t in enumerate(texts)
        for p, g in grams(t, 9)
        for j, d in enumerate(train)
        for q, h in grams(d, 9)
        if g == h
    }
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_closing_phrase_matches_at_13_words_and_not_at_12(spark):
    phrase = r"is $\frac{m}{n}$, where $m$ and $n$ are relatively prime positive integers. Find $m+n$."
    item = "The chance that the last word on the list has a given letter in it " + phrase
    train = [
        "The greatest value that the squared radius of such a ball can have " + phrase + "\n",
        "The value " + phrase.replace("is $", "equals $"),  # shares 12 words
    ]
    bench = make_bench(spark, {"contest": [item] * 3})
    found = contamination_matches(make_train(spark, train), bench)
    assert {r["train_idx"] for r in found.collect()} == {0}


def test_detection_agrees_with_pairs(spark, all_sizes):
    train, items = corpus()
    items["none"] = ["z " * 20]
    sources = [f"s{i % 3}" for i in range(len(train))]
    lengths = {b: percentile_n(t) for b, t in items.items()}
    want = brute_pairs(train, items, lengths)
    train_df, bench = make_train(spark, train, sources), make_bench(spark, items)
    found = detect(train_df, bench, carry=["source"])
    assert {(r[0], r[1]) for r in found.flagged.collect()} == {(b, j) for b, _, j in want}
    assert {tuple(r) for r in found.touched.collect()} == {(b, i) for b, i, _ in want}
    assert found.flagged_rows().count() == len({j for _, _, j in want})

    summary = {r["benchmark"]: r for r in contamination_summary(found, bench).collect()}
    for b, texts in items.items():
        tests = len({i for c, i, _ in want if c == b})
        assert summary[b]["test_size"] == len(texts)
        assert summary[b]["contaminated_test"] == tests
        assert summary[b]["contamination_rate"] == tests / len(texts) * 100
        assert summary[b]["num_contaminated_train"] == len({j for c, _, j in want if c == b})
    assert summary["none"]["contaminated_test"] == 0

    listed = [tuple(r) for r in contaminated_indices(found).collect()]
    assert listed == sorted({(b, j) for b, _, j in want})
    total = contamination_total(found, train_df).first()
    union = len({j for _, _, j in want})
    assert total["total_contaminated_train"] == union
    assert total["contaminated_pct"] == union / len(train) * 100


def test_pair_reports(spark, all_sizes):
    train, items = corpus()
    sources = [f"s{i % 3}" for i in range(len(train))]
    want = brute_pairs(train, items, {b: percentile_n(t) for b, t in items.items()})
    train_df, bench = make_train(spark, train, sources), make_bench(spark, items)
    pairs = contamination_matches(train_df, bench, carry=["source"])
    by_source = {r["train_source"]: r["pairs"] for r in match_sources(pairs).collect()}
    assert by_source == {
        s: sum(sources[j] == s for _, _, j in want) for s in {sources[j] for _, _, j in want}
    }
    details = match_details(pairs, train_df, bench).collect()
    assert {(r["benchmark"], r["test_idx"], r["train_idx"]) for r in details} == want
    for r in details:
        assert r["test_prompt"] == items[r["benchmark"]][r["test_idx"]]
        assert r["test_id"] == f"{r['benchmark']}-{r['test_idx']}"
        assert r["train_prompt"] == train[r["train_idx"]]
        assert (r["train_id"], r["train_source"]) == (
            f"t{r['train_idx']}",
            sources[r["train_idx"]],
        )


def test_phrase_shared_by_most_rows(spark, all_sizes):
    """A hot n-gram: most rows and items share one sentence."""
    phrase = " ".join(f"w{i}" for i in range(13))
    train = [f"{phrase} row {i}" for i in range(400)] + [f"row {i} only" for i in range(100)]
    bench = make_bench(spark, {"b": [f"item {i} {phrase}" for i in range(30)]})
    found = detect(make_train(spark, train), bench)
    assert found.flagged.count() == 400 and found.touched.count() == 30
    assert contamination_matches(make_train(spark, train), bench).count() == 400 * 30


def test_tokenizer_argument(spark):
    train = make_train(spark, ["ONE two, three", "one two three"])
    bench = make_bench(spark, {"b": ["one two three"]})
    bare = lambda c: words(F.regexp_replace(F.lower(c), "[^a-z ]", ""))
    plain = contamination_matches(train, bench, n=3)
    assert {r["train_idx"] for r in plain.collect()} == {1}
    custom = contamination_matches(train, bench, n=3, tokenizer=bare)
    assert {r["train_idx"] for r in custom.collect()} == {0, 1}


def test_items_too_short_are_never_flagged(spark, all_sizes):
    train = make_train(spark, ["a b c", "a b c d e f g h i j"])
    bench = make_bench(spark, {"b": ["a b c", "d e"]})
    found = detect(train, bench)
    assert found.flagged.count() == 0 and found.touched.count() == 0
    assert contamination_summary(found, bench).first()["contamination_rate"] == 0.0
