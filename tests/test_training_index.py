from __future__ import annotations

import random

import pytest
from test_matching import make_bench, make_train

from evalsieve.operators import contamination, ngrams, training_index


def case():
    draw = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {b: [" ".join(draw.choices(vocabulary, k=draw.randint(6, 40))) for _ in range(8)] for b in ("one", "two")}
    pool = [i for own in items.values() for i in own]
    texts = []
    for _ in range(60):
        cut = draw.choice(pool).split()
        a = draw.randrange(len(cut))
        texts.append(" ".join(draw.choices(vocabulary, k=30) + cut[a : a + draw.randint(5, 20)] + draw.choices(vocabulary, k=5)))
    return texts + ["", "short text"], items


def plain(detection):
    return (
        {tuple(r) for r in detection.flagged.select("benchmark", "train_idx").collect()},
        {tuple(r) for r in detection.touched.collect()},
    )


@pytest.mark.parametrize("n", [None, 9])
def test_same_as_detection(spark, tmp_path, all_sizes, n):
    texts, items = case()
    train, folder = make_train(spark, texts), str(tmp_path / "index")
    training_index.add_rows(train.where("row_idx < 25"), folder, buckets=4)
    training_index.add_rows(train.where("row_idx >= 25"), folder, buckets=4)  # an append
    training_index.add_rows(train.where("row_idx < 3"), folder, buckets=4)  # again
    for own in ({"one": items["one"]}, items):  # benchmarks come one after the other
        bench = make_bench(spark, own)
        found = training_index.detect(train, bench, folder, n, buckets=4)
        wanted = plain(contamination.detect(train, bench, n))
        assert plain(found) == wanted and wanted[0]


def test_candidates_are_few_and_the_index_stays(spark, tmp_path, monkeypatch):
    texts, items = case()
    train, folder = make_train(spark, texts), str(tmp_path / "index")
    training_index.add_rows(train, folder, buckets=4)
    terms = ngrams.settled_terms(make_bench(spark, {"one": items["one"][:1]}), 8)
    assert training_index.candidates(spark, folder, terms, 4).count() < 20
    # a benchmark too large for a broadcast: only its own marks are shuffled
    spark.conf.set("spark.evalsieve.broadcastRows", "0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = training_index.candidates(spark, folder, terms, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.evalsieve.broadcastRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scans = plan[plan.index("Join"):]
    assert "Bucketed: true" in plan and scans.count("Exchange hashpartitioning(mark") == 1


def test_every_mark_of_a_row_is_kept_once(spark, tmp_path):
    draw = random.Random(5)
    texts = [" ".join(draw.choices("abcdef", k=k)) for k in (0, 7, 8, 9, 12, 13, 40, 300)] + [None]
    train = make_train(spark, texts)
    runs = train.select("row_idx", ngrams._run_hashes(ngrams.tokenize("prompt"), 4).alias("runs")).where(
        "size(split(prompt, ' ')) >= 8")
    wanted: dict[tuple[int, int], int] = {}
    for row, hashes in runs.collect():
        for n in training_index.LENGTHS:
            for i in range(len(hashes) - (n - 4)):
                wanted[row, min(hashes[i : i + n - 3])] = n  # the greatest comes last
    folder = str(tmp_path / "index")
    training_index.add_rows(train, folder, buckets=4)
    found = spark.read.parquet(folder).collect()
    assert len(found) == len(wanted)
    assert {(r["row_idx"], r["mark"]): r["n"] for r in found} == wanted


def test_other_lengths_are_refused(spark, tmp_path):
    texts, items = case()
    train, folder = make_train(spark, texts), str(tmp_path / "index")
    training_index.add_rows(train, folder, lengths=[8, 9], buckets=4)
    with pytest.raises(ValueError, match="12"):
        training_index.detect(train, make_bench(spark, items), folder, n=12, lengths=[8, 9], buckets=4)
