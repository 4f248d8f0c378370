from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalsieve.operators import scoring
from evalsieve.plans import jobs
from evalsieve.sources import files


def write_json(path, value):
    path.parent.mkdir(exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_json_array_with_missing_keys(spark, tmp_path):
    rows = [{"prompt": "é q", "id": "1"}, {"prompt": "r", "answer": "2", "source": "s", "id": "2"}]
    path = write_json(tmp_path / "rows.json", rows)
    found = files.number_rows(files.read_json_array(spark, path)).orderBy("row_idx").collect()
    assert [r["row_idx"] for r in found] == [0, 1]
    assert (found[0]["prompt"], found[0]["answer"], found[0]["source"]) == ("é q", None, None)
    assert found[1]["answer"] == "2"


def test_broken_input_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"prompt": "a"}, {"prompt": ')
    (tmp_path / "bad.jsonl").write_text('{"question": "a"}\n{"question": \n')
    with pytest.raises(Exception, match="FAILFAST"):
        files.read_json_array(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception, match="FAILFAST"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_jsonl_skips_blank_lines_and_keeps_text(spark, tmp_path):
    path = tmp_path / "pool.jsonl"
    path.write_text('{"question": "é\\n1", "id": "a"}\n\n   \n{"question": "b", "id": "b"}\n', "utf-8")
    df = files.read_jsonl(spark, str(path))
    assert [r["question"] for r in df.orderBy("id").collect()] == ["é\n1", "b"]
    files.write_jsonl(df, str(tmp_path / "out"))
    files.write_jsonl(df, str(tmp_path / "out"))  # a rerun replaces, never appends
    text = "".join(p.read_text("utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert "é" in text and text.count("\n") == 2


def test_positions_follow_path_and_place(spark, tmp_path, all_sizes):
    """Files of very different sizes: tasks do not read them in path order."""
    want = []
    for name, n in (("a", 3), ("b", 40_000), ("c", 1), ("d", 500)):
        rows = [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text(
            "".join(json.dumps({"question": r, "id": "x" * 30}) + "\n" for r in rows)
        )
        want += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        found = files.number_rows(files.read_jsonl(spark, str(tmp_path)))
        if all_sizes != "shuffle":
            assert found.rdd.getNumPartitions() > 4
        assert [r[0] for r in found.orderBy("row_idx").select("question").collect()] == want
        assert found.agg(F.max("row_idx")).first()[0] == len(want) - 1
        # the numbers are those of a file whatever columns are read
        assert {r[0] for r in found.where("question = 'c0'").select("row_idx").collect()} == {40_003}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_parquet_positions(spark, tmp_path, all_sizes):
    """Several files and row groups; a filter does not change the numbers."""
    path = str(tmp_path / "rows")
    spark.range(0, 9000, numPartitions=3).write.option("parquet.block.size", "4096").parquet(path)
    found = files.number_rows(spark.read.parquet(path))
    assert found.where("id <> row_idx").count() == 0
    assert sorted(r["row_idx"] for r in found.collect()) == list(range(9000))
    assert [r["row_idx"] for r in found.where("id = 8123").collect()] == [8123]


def test_metrics_identity_comes_from_the_file_name(spark, tmp_path):
    record = {
        "model_id": "m",
        "num_examples": 4,
        "prefix_ratios": [1.0, 0.4],
        "correct_counts": {"1.0": 3, "0.4": 1},
        "accuracies": {"1.0": 0.75, "0.4": 0.25},
        "avg_rougeL_f": {"1.0": 0.0, "0.4": 0.5},
        "no_boxed_counts": {"1.0": 0, "0.4": 2},
        "no_boxed_ratios": {"1.0": 0.0, "0.4": 0.5},
    }
    write_json(tmp_path / "eval_math500_my_eval_model_vllm.json", record)
    write_json(tmp_path / "eval_aime2025_x.y_vllm.json", record)
    results = jobs.collect_results(spark, str(tmp_path / "eval_*_vllm.json"), str(tmp_path / "csv"))
    rows = [tuple(r) for r in files.read_results(spark, str(tmp_path / "csv")).collect()]
    assert sorted(rows) == sorted(tuple(r) for r in results.collect())
    assert ("my_eval_model", "math500", 0.4, 0.25, 1, 4, 0.5, 2, 0.5) in rows
    assert {r[:2] for r in rows} == {("my_eval_model", "math500"), ("x.y", "aime2025")}
    head = sorted((tmp_path / "csv").glob("part-*"))[0].read_text().splitlines()
    assert head[0] == ",".join(files.RESULT_COLUMNS)
    assert [line.split(",")[0] for line in head[1:]][0] == "my_eval_model" or len(head) < 5


def test_jobs_from_files_to_files(spark, tmp_path):
    run = " ".join(f"w{i}" for i in range(20))
    train = [
        {"prompt": f"text {i} " + (run if i % 4 == 0 else "own words"), "source": f"s{i % 2}", "id": f"t{i}"}
        for i in range(40)
    ]
    bench = {
        "first-set": [{"prompt": run, "answer": "1", "id": "0"}, {"prompt": "z " * 30, "id": "1"}],
        "second.set": [{"prompt": "y " * 30, "id": "0"}],
    }
    train_path = write_json(tmp_path / "train.json", train)
    bench_paths = [write_json(tmp_path / f"{b}.json", rows) for b, rows in bench.items()]
    out = str(tmp_path / "out")

    summary = {r["benchmark"]: r for r in jobs.detect(spark, train_path, bench_paths, out).collect()}
    assert (summary["first-set"]["contaminated_test"], summary["first-set"]["test_size"]) == (1, 2)
    assert summary["second.set"]["num_contaminated_train"] == 0

    def records(folder):
        paths = sorted((tmp_path / "out" / folder).glob("part-*"))
        return [json.loads(x) for p in paths for x in p.read_text("utf-8").splitlines()]

    (record,) = records("contamination_summary")
    assert record["training_size"] == 40 and record["total_contaminated_train"] == 10
    union = [r["train_idx"] for r in records(record["flagged_union_folder"])]
    assert sorted(union) == list(range(0, 40, 4))
    flagged = [(r["benchmark"], r["train_idx"]) for r in records(record["flagged_folder"])]
    assert sorted(flagged) == [("first-set", i) for i in range(0, 40, 4)]
    assert [b["benchmark"] for b in record["benchmarks"]] == ["first-set", "second.set"]
    assert [b["unmatchable_test"] for b in record["benchmarks"]] == [0, 0]
    assert len(records("contamination_pairs")) == len(records("matched_rows")) == 10
    jobs.detect(spark, train_path, bench_paths, out, details=True)
    matches = records("contamination_matches")
    assert len(matches) == 10 and {m["test_id"] for m in matches} == {"0"}
    assert {m["train_id"] for m in matches} == {f"t{i}" for i in range(0, 40, 4)}

    report = {r["source"]: r for r in jobs.clean(spark, train_path, out, out).collect()}
    assert (report["s0"]["removed"], report["s1"]["removed"]) == (10, 0)
    assert sorted(r["row_idx"] for r in records("clean_train_indices")) == [
        i for i in range(40) if i % 4
    ]
    cleaned = f"{out}/decontaminated"
    assert jobs.verify(spark, cleaned, bench_paths, out).first()["all_clean"] is True
    (verified,) = records("verification_summary")
    assert verified["all_clean"] is True and verified["training_size"] == 30

    # a cleaned set can be searched and cleaned again, with another n and other words
    again = jobs.detect(spark, cleaned, bench_paths, f"{out}/again", form="lines", n=9, pairs=False)
    assert {r["contaminated_test"] for r in again.collect()} == {0}
    jobs.clean(spark, cleaned, f"{out}/again", f"{out}/again", form="lines")
    spark.read.json(cleaned).write.parquet(f"{out}/parquet")
    assert jobs.verify(spark, f"{out}/parquet", bench_paths, out, form="parquet").first()["all_clean"]

    jobs.convert(spark, cleaned, f"{out}/all")
    assert len(records("all")) == 30
    jobs.sample(spark, f"{out}/all", f"{out}/pool", k=5)
    assert len(records("pool")) == 10
    shown = jobs.teach(spark, f"{out}/pool", f"{out}/pairs", lambda: lambda ps: [" done "] * len(ps), tasks=2)
    pairs = records("pairs")
    assert len(pairs) == 10 and {p["target_text"] for p in pairs} == {"done"}
    assert [r["row_idx"] for r in shown.orderBy("row_idx").collect()] == [0, 5, 9]

    other = write_json(tmp_path / "other.json", train[:39])
    with pytest.raises(ValueError, match="39"):
        jobs.clean(spark, other, out, out)


def test_teaching_keeps_every_row(spark, tmp_path):
    """Equal and missing ids give one pair for each row, and nothing is shuffled."""
    rows = [{"question": f"q{i}", "source": "s", **({"id": "x"} if i < 3 else {})} for i in range(4)]
    (tmp_path / "pool.jsonl").write_text("\n".join(map(json.dumps, rows)))
    jobs.teach(spark, str(tmp_path / "pool.jsonl"), str(tmp_path / "pairs"), lambda: lambda ps: [p.split("Problem:\n")[1] for p in ps])
    pairs = spark.read.json(str(tmp_path / "pairs")).collect()
    assert sorted(r["target_text"].split()[0] for r in pairs) == ["q0", "q1", "q2", "q3"]
    assert all(r["target_text"].split()[0] in r["input_text"] for r in pairs)


def test_teaching_with_a_ledger(spark, tmp_path):
    """Faults are listed beside the pairs; the next run asks only for them."""
    rows = [{"question": f"q{i}", "source": "s", "id": str(i)} for i in range(4)]
    (tmp_path / "pool.jsonl").write_text("\n".join(map(json.dumps, rows)))
    paths = [str(tmp_path / n) for n in ("pool.jsonl", "pairs")]

    def picky(prompts):
        if any("q2" in p for p in prompts):
            raise ValueError("cannot")
        return ["one" for _ in prompts]

    jobs.teach(spark, *paths, lambda: picky, ledger=str(tmp_path / "ledger"))
    assert [r.id for r in spark.read.json(f"{paths[1]}_errors").collect()] == ["2"]
    assert spark.read.json(paths[1]).count() == 3
    jobs.teach(spark, *paths, lambda: lambda ps: ["two" for _ in ps], ledger=str(tmp_path / "ledger"))
    assert sorted(r.target_text for r in spark.read.json(paths[1]).collect()) == ["one", "one", "one", "two"]
    assert spark.read.schema("id string").json(f"{paths[1]}_errors").count() == 0


def test_benchmarks_of_one_name_stay_apart(spark, tmp_path):
    sizes = {"a/test": 5, "m/other": 2, "z/test": 5}
    paths = [write_json(tmp_path / f"{p}.json", [{"prompt": f"{p} {i}"} for i in range(n)]) for p, n in sizes.items()]
    found = files.read_benchmarks(spark, paths).collect()
    for p, n in sizes.items():
        own = sorted((r["test_idx"], r["prompt"]) for r in found if r["benchmark"].endswith(p.removeprefix("m/")))
        assert own == [(i, f"{p} {i}") for i in range(n)]
    assert {r["benchmark"] for r in found if r["prompt"].startswith("m")} == {"other"}


def test_question_files(spark, tmp_path):
    rows = [{"question": f"q{i}", "answer": str(i), **({"id": f"own{i}"} if i % 2 else {})} for i in range(6)]
    (tmp_path / "math500.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "aime2025.jsonl").write_text(json.dumps(rows[0]))
    found = files.read_questions(spark, [str(tmp_path / "math500.jsonl"), str(tmp_path / "aime2025.jsonl")], limit=3)
    assert {tuple(r) for r in found.collect()} == {
        ("math500", "ex_0", "q0", "0"), ("math500", "own1", "q1", "1"), ("math500", "ex_2", "q2", "2"),
        ("aime2025", "ex_0", "q0", "0"),
    }
    results = jobs.evaluate_files(
        spark, str(tmp_path / "math500.jsonl"), {"m": lambda: lambda ps: [r"\boxed{1}"] * len(ps)}, str(tmp_path / "out"))
    assert {(r["total"], r["correct"]) for r in results.collect()} == {(6, 1)}


def test_unknown_metric_files_fail(spark, tmp_path):
    write_json(tmp_path / "eval_aime2025_vllm.json", {"num_examples": 1, "prefix_ratios": [1.0]})
    with pytest.raises(Exception, match="no dataset and model"):
        files.read_metrics(spark, str(tmp_path / "eval_*_vllm.json")).collect()


def test_text_reads_leave_the_session_alone(spark, tmp_path):
    key = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(key, None)
    (tmp_path / "t.jsonl").write_text('{"prompt": "a"}\n{"prompt": "b"}')
    assert files.read_training(spark, str(tmp_path / "t.jsonl"), "lines").count() == 2
    assert spark.conf.get(key, None) == before


def test_a_job_leaves_only_its_outputs(spark, tmp_path):
    folder = spark.conf.get("spark.checkpoint.dir")
    settled = lambda: {p for p in Path(folder).glob("evalsieve-*/*")}
    before = settled()
    rows = [{"prompt": "w " * 30, "source": "s", "id": "t"}]
    path = write_json(tmp_path / "x.json", rows)
    jobs.detect(spark, path, [path], str(tmp_path / "out")).collect()
    jobs.clean(spark, path, str(tmp_path / "out"), str(tmp_path / "out")).collect()
    assert settled() == before
    assert {p.name for p in (tmp_path / "out").iterdir()} == {
        "summary", "contamination_summary", "flagged", "flagged_union", "contamination_pairs", "matched_rows",
        "items", "decontaminated", "clean_train_indices", "report"}


def test_evaluation_counts_missing_completions_and_runs_once(spark, tmp_path):
    questions = spark.createDataFrame(
        [("math500", i, f"question number {i} with words", "5") for i in range(6)]
        + [("aime2025", i, "asked of no model", "5") for i in range(2)],
        "dataset string, id long, question string, answer string",
    )
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(len(batch))
            yield batch

    grid = scoring.prefix_grid(questions).where("dataset = 'math500' and not (id = 2 and ratio = 0.4)")
    made = grid.select(F.lit("m").alias("model"), "dataset", "id", "ratio", F.lit(r"\boxed{5}").alias("generated"))
    made = made.mapInPandas(count, made.schema)
    results = {r["prefix_ratio"]: r for r in jobs.evaluate(questions, made, str(tmp_path / "out")).collect()}
    assert computed.value == 23
    assert {r["total"] for r in results.values()} == {6} and results[0.4]["correct"] == 5
    assert results[0.4]["no_boxed_count"] == 1 and results[0.4]["accuracy"] == 5 / 6
    again = jobs.collect_results(spark, str(tmp_path / "out" / "metrics"), str(tmp_path / "csv"), form="lines")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in results.values()}


def test_evaluation_job(spark, tmp_path):
    questions = spark.createDataFrame(
        [("math500", i, f"question number {i} with words", "5") for i in range(6)],
        "dataset string, id long, question string, answer string",
    )
    grid = scoring.prefix_grid(questions)
    made = grid.select(
        F.lit("m").alias("model"), "dataset", "id", "ratio",
        F.concat("tail", F.lit(r" \boxed{5}")).alias("generated"),
    )
    results = jobs.evaluate(questions, made, str(tmp_path / "out"))
    rows = {r["prefix_ratio"]: r for r in results.collect()}
    assert all(r["accuracy"] == 1.0 for r in rows.values())
    assert rows[1.0]["avg_rougeL_f"] == 0.0 and rows[0.4]["avg_rougeL_f"] > 0.5
    back = files.read_results(spark, str(tmp_path / "out" / "results"))
    assert back.exceptAll(results).count() == 0 and back.count() == 4
