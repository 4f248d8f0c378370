from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalsieve import (
    batch_complete,
    build_prompts,
    convert,
    first_rows,
    pairing_faults,
    resumable_complete,
    sft_examples,
    shard,
    shard_rows,
    stratified_sample,
    teacher_pairs,
    teacher_preview,
)

ROWS = "row_idx long, prompt string, answer string, source string, id string"


def test_convert_defaults(spark):
    df = spark.createDataFrame(
        [(7, "q", None, None, None), (8, "r", "5", "src", "given")], ROWS
    ).coalesce(1)
    assert [tuple(r) for r in convert(df).collect()] == [
        ("q", "UNKNOWN", "train_000007"),
        ("r", "src", "given"),
    ]
    assert [tuple(r) for r in convert(df, "benchmark").collect()] == [
        ("q", "", "UNKNOWN", "benchmark_000007"),
        ("r", "5", "src", "given"),
    ]
    with pytest.raises(ValueError):
        convert(df, "other")


def pool(spark, sizes):
    rows = [(f"{s}-{i}", s) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, source string").repartition(5)


def draws(seed, ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


@pytest.mark.parametrize("k", [1, 37, 2000])
def test_sample_is_exact_and_reproducible(spark, all_sizes, k):
    """One source holds most rows; another is smaller than k; one has no name."""
    sizes = {"hot": 4000, "mid": 300, "tiny": 3, None: 50}
    found = stratified_sample(pool(spark, sizes), k=k, seed=42).collect()
    want = {
        i for s, n in sizes.items() for i in draws(42, [f"{s}-{j}" for j in range(n)])[:k]
    }
    assert {r["id"] for r in found} == want and len(found) == len(want)
    assert Counter(r["source"] for r in found) == {
        s or "UNKNOWN": min(k, n) for s, n in sizes.items()
    }
    order = [r["id"] for r in sorted(found, key=lambda r: r["shuffle_rank"])]
    assert order == draws(43, want)
    assert sorted(r["shuffle_rank"] for r in found) == list(range(len(want)))


def test_other_seed_gives_other_rows(spark):
    df = pool(spark, {"a": 500})
    one, two = ({r["id"] for r in stratified_sample(df, k=50, seed=s).collect()} for s in (1, 2))
    assert one != two and len(one) == len(two) == 50


def test_shards_make_up_the_whole(spark):
    df = spark.range(100).withColumnRenamed("id", "row_idx")
    parts = [{r[0] for r in shard_rows(df, k, 3).collect()} for k in range(3)]
    assert sorted(x for p in parts for x in p) == list(range(100)) and 7 in parts[1]
    assert {(r["row_idx"] % 3, r["shard"]) for r in shard(df, 3).collect()} == {
        (0, 0),
        (1, 1),
        (2, 2),
    }


def test_first_rows(spark):
    df = spark.range(10).withColumnRenamed("id", "row_idx")
    assert [first_rows(df, n).count() for n in (0, 3, 50)] == [10, 3, 10]


def test_pairs_meet_by_key(spark):
    pool_df = spark.createDataFrame(
        [(f"q{i}", f"100% {i}", "s") for i in range(50)], "id string, question string, source string"
    )
    completions = spark.createDataFrame(
        [(f"q{i}", f"\n answer {i}  ") for i in reversed(range(50))],
        "id string, completion string",
    )
    pairs = teacher_pairs(build_prompts(pool_df), completions).collect()
    assert len(pairs) == 50
    for r in pairs:
        i = r["id"][1:]
        assert r["target_text"] == f"answer {i}" and f"\n100% {i}\n" in r["input_text"]


@pytest.mark.parametrize("n, shown", [(1, [0]), (2, [0]), (3, [0, 1, 2]), (10, [0, 5, 9])])
def test_preview(spark, n, shown):
    pairs = spark.range(n).select(
        F.col("id").alias("row_idx"),
        F.col("id").cast("string").alias("id"),
        F.lit("i" * 300).alias("input_text"),
        F.lit("t" * 300).alias("target_text"),
    )
    rows = teacher_preview(pairs).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in rows] == shown
    assert len(rows[0]["input_preview"]) == 100 and len(rows[0]["target_preview"]) == 150


def test_long_and_short_rows_keep_their_whitespace(spark):
    text = "a\n\nb c\u2003d\x1c e  f g"
    pairs = spark.createDataFrame([("i", "s", "", text)], "id string, source string, input_text string, target_text string")
    cut = {n: sft_examples(pairs, max_tokens=n).first() for n in (1, 3, 5, 7, 50)}
    assert [cut[n]["text"] for n in cut] == ["a", "a\n\nb c", "a\n\nb c\u2003d\x1c e", text, text]
    assert [cut[n]["truncated"] for n in cut] == [True, True, True, False, False]


def test_faults_of_outside_completions(spark):
    prompts = spark.createDataFrame([("a", "p"), ("b", "p"), ("b", "p"), (None, "p"), ("c", "p")], "id string, prompt string")
    made = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "x"), ("d", "x")], "id string, completion string")
    found = {tuple(r) for r in pairing_faults(prompts, made).collect()}
    assert found == {("b", 2, 1), (None, 1, 0), ("c", 1, 0), ("d", 0, 2)}


def test_repeated_sample_keys_are_refused(spark):
    rows = spark.range(10).selectExpr("'same' as id", "'s' as source")
    with pytest.raises(Exception, match="unique keys"):
        stratified_sample(rows, k=2).collect()
    assert stratified_sample(spark.range(10).selectExpr("id as row_idx", "'s' as source"), k=2, key="row_idx").count() == 2


def test_sft_budget(spark):
    pairs = spark.createDataFrame(
        [("a", "s", "one  two\n", "three"), ("b", "s", "one  two\n", "three four")],
        "id string, source string, input_text string, target_text string",
    ).coalesce(1)
    rows = sft_examples(pairs, max_tokens=3).collect()
    assert [tuple(r) for r in rows] == [
        ("a", "s", "one  two\nthree", 3, False),
        ("b", "s", "one  two\nthree", 3, True),
    ]


def test_generator_runs_in_batches_and_keeps_keys(spark):
    prompts = spark.range(1000).select("id", F.col("id").cast("string").alias("prompt"))

    def load():
        state = {"calls": 0}

        def generate(texts):
            state["calls"] += 1
            return [f"{t}!" for t in texts]

        return generate

    rows = batch_complete(prompts, load, tasks=4).collect()
    assert {(r["id"], r["completion"]) for r in rows} == {(i, f"{i}!") for i in range(1000)}


def test_generator_must_answer_every_prompt(spark):
    prompts = spark.range(5).select("id", F.lit("p").alias("prompt"))
    with pytest.raises(Exception, match="5 prompts gave 4|prompts gave"):
        batch_complete(prompts, lambda: lambda texts: texts[1:], tasks=1).collect()


def test_completion_goes_on_after_a_death(spark, tmp_path):
    """A generator that dies midway is called once for each prompt over two runs."""
    prompts = spark.range(40).select("id", F.concat(F.lit("p"), F.col("id") % 20).alias("prompt"))
    log, alive = tmp_path / "asked", tmp_path / "alive"
    log.mkdir()

    def load():
        def generate(texts):
            if not alive.exists() and len(list(log.iterdir())) >= 8:
                raise SystemExit("the generator died")
            for t in texts:
                with open(log / t, "a") as f:
                    f.write("x")
            return [t.upper() for t in texts]

        return generate

    ledger = str(tmp_path / "ledger")
    with pytest.raises(Exception):
        resumable_complete(prompts, load, ledger, tasks=1, rounds=6).collect()
    before = len(list(log.iterdir()))
    assert 8 <= before < 20
    alive.touch()
    rows = resumable_complete(prompts, load, ledger, tasks=1, rounds=6).collect()
    assert {(r.id, r.completion, r.error) for r in rows} == {(i, f"P{i % 20}", None) for i in range(40)}
    assert {p.name: p.read_text() for p in log.iterdir()} == {f"p{i}": "x" for i in range(20)}


def test_failed_prompts_are_rows_and_tried_again(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None), (4, "a")], "id long, prompt string")

    def picky(texts):
        if "bad" in texts:
            raise ValueError("cannot")
        return [t + "!" for t in texts]

    ledger = str(tmp_path / "ledger")
    first = resumable_complete(prompts, lambda: picky, ledger, rounds=2).collect()
    assert {(r.id, r.completion, r.error) for r in first} == {
        (1, "a!", None), (4, "a!", None), (2, None, "ValueError: cannot"), (3, None, "no prompt")}
    mended = resumable_complete(prompts, lambda: lambda ts: [t + "?" for t in ts], ledger, rounds=2).collect()
    assert {(r.id, r.completion, r.error) for r in mended} == {
        (1, "a!", None), (4, "a!", None), (2, "bad?", None), (3, None, "no prompt")}
    assert resumable_complete(prompts.limit(0), lambda: picky, ledger, rounds=2).count() == 0
