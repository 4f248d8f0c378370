from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from test_text import last_box, lcs_table, normal_form

from evalsieve import (
    eval_metrics,
    flatten_metrics,
    memorization,
    metrics_records,
    predictions,
    prefix_grid,
    score,
)
from evalsieve.operators.scoring import RATIOS
from evalsieve.plans import reports

SEED = 5
QUESTIONS = "dataset string, id long, question string, answer string"
COMPLETIONS = "model string, dataset string, id long, ratio double, generated string"


def case():
    rng = random.Random(SEED)
    vocabulary = ["a", "B,", "c-d", "é", "9", "(x)"]
    questions = [
        (d, i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))), rng.choice(["5", " $7$."]))
        for d in ("math500", "aime2025")
        for i in range(20)
    ]
    completions = [
        (m, d, i, r, "  " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + ending)
        for m in ("base", "student")
        for d, i, _, _ in questions
        for r in RATIOS
        for ending in [rng.choice(["", r" \boxed{5}", r"\boxed{$7$.}", r"\boxed{\text{5}}"])]
    ]
    return questions, completions


def rouge(tail, generated):
    if not tail:
        return 0.0
    cut = " ".join(generated.split()[: len(tail.split())])
    a, b = (re.findall("[a-z0-9]+", t.lower()) for t in (tail, cut))
    shared = lcs_table(a, b) if a and b else 0
    if not shared:
        return 0.0
    p, r = shared / len(b), shared / len(a)
    return 2 * p * r / (p + r)


def expected():
    questions, completions = case()
    asked = {(d, i): (q, a) for d, i, q, a in questions}
    rows = {}
    for m, d, i, r, g in completions:
        q, a = asked[d, i]
        size = len(q) if r >= 1 else max(1, int(len(q) * r))
        box = last_box(g)
        norm = normal_form(box) if box else ""
        rows[m, d, i, r] = {
            "truncated_question": q[:size],
            "pred_answer_raw": box,
            "pred_answer_norm": norm,
            "correct": norm != "" and norm == normal_form(a),
            "generated_length": len(g),
            "rougeL_f": rouge(q[size:], g),
            "gold_tail_length": len(q) - size,
        }
    return rows


@pytest.fixture
def scored(spark):
    questions, completions = case()
    grid = prefix_grid(spark.createDataFrame(questions, QUESTIONS))
    made = spark.createDataFrame(completions, COMPLETIONS)
    return memorization(score(grid, made))


def test_grid(spark):
    questions, _ = case()
    grid = prefix_grid(spark.createDataFrame(questions, QUESTIONS)).collect()
    assert len(grid) == len(questions) * 4
    assert all(r["shown"] + r["tail"] == r["question"] for r in grid)
    assert all(f"\n{r['shown']}\n" in r["prompt"] for r in grid)


def test_rows_match_brute_force(spark, all_sizes):
    questions, completions = case()
    grid = prefix_grid(spark.createDataFrame(questions, QUESTIONS))
    rows = memorization(score(grid, spark.createDataFrame(completions, COMPLETIONS))).collect()
    want = expected()
    assert len(rows) == len(want)
    for r in rows:
        values = want[r["model"], r["dataset"], r["id"], r["ratio"]]
        assert {k: r[k] for k in values} == values
        assert r["no_boxed"] == (r["pred_answer_raw"] == "")
    assert sum(v["rougeL_f"] > 0 for v in want.values()) > 50
    assert all(v["rougeL_f"] == 0 for (_, _, _, ratio), v in want.items() if ratio == 1.0)


def test_metrics_match_brute_force(scored):
    want = expected()
    found = eval_metrics(scored).collect()
    assert len(found) == 2 * 2 * 4
    for r in found:
        cell = [
            v
            for (m, d, _, ratio), v in want.items()
            if (m, d, ratio) == (r["model"], r["dataset"], r["prefix_ratio"])
        ]
        assert r["total"] == len(cell) == 20
        assert r["correct"] == sum(v["correct"] for v in cell)
        assert r["accuracy"] == r["correct"] / 20
        assert r["no_boxed_count"] == sum(v["pred_answer_raw"] == "" for v in cell)
        assert r["no_boxed_ratio"] == r["no_boxed_count"] / 20
        assert r["avg_rougeL_f"] == pytest.approx(sum(v["rougeL_f"] for v in cell) / 20)


def test_predictions_hold_every_ratio(scored):
    want = expected()
    rows = predictions(scored).collect()
    assert len(rows) == 2 * 40
    for r in rows:
        assert set(r["per_prefix"]) == {"1.0", "0.8", "0.6", "0.4"}
        for ratio, values in r["per_prefix"].items():
            assert values.asDict() == want[r["model"], r["dataset"], r["id"], float(ratio)]


def test_records_flatten_back(scored):
    results = eval_metrics(scored)
    back = flatten_metrics(metrics_records(results))
    assert back.columns == results.columns
    assert back.exceptAll(results).count() == 0 and results.exceptAll(back).count() == 0
    record = metrics_records(results).first()
    assert record["prefix_ratios"] == [1.0, 0.8, 0.6, 0.4] and record["num_examples"] == 20


RESULTS = (
    "model string, dataset string, prefix_ratio double, accuracy double, correct long, total long, "
    "avg_rougeL_f double, no_boxed_count long, no_boxed_ratio double"
)


def result_rows(spark):
    rows = [
        ("Qwen2.5-1.5B", "math500", 1.0, 0.25, 1, 4, 0.0, 1, 0.25),
        ("Qwen2.5-1.5B", "math500", 0.4, 0.0, 0, 4, 0.5, 4, 1.0),
        ("Qwen2.5-1.5B", "aime2025", 1.0, 0.5, 1, 2, 0.0, 0, 0.0),
        ("Qwen2.5-Math-7B-Instruct", "math500", 1.0, 0.75, 3, 4, 0.0, 0, 0.0),
        ("stranger", "math500", 1.0, 0.0, 0, 4, 0.0, 0, 0.0),
    ]
    return spark.createDataFrame(rows, RESULTS)


def test_reports(spark):
    rows = result_rows(spark)
    compared = reports.model_comparison(rows).collect()
    assert [(r["model_label"], r["accuracy_pct"]) for r in compared] == [
        (None, 0.0),
        ("Qwen2.5-1.5B (Base)", 25.0),
        ("Qwen2.5-Math-7B (Teacher)", 75.0),
    ]
    curve = reports.accuracy_curve(rows).collect()
    assert [r["prefix_ratio"] for r in curve[:2]] == [0.4, 1.0] and len(curve) == 4
    families = [tuple(r) for r in reports.family_transfer(rows).collect()]
    assert families[0] == ("Llama", 0, "Llama 3.1-8B (Teacher)", None)
    assert [f[3] for f in families] == [None, None, None, 75.0, 25.0, None]
    quality = reports.format_quality(rows).collect()
    assert (quality[0]["valid_boxed_pct"], quality[0]["no_boxed_pct"]) == (75.0, 25.0)
    memory = reports.memorization_curve(rows).collect()
    assert [(r["prefix_ratio"], r["avg_rougeL_f"]) for r in memory] == [(0.4, 0.5)]
    pivot = reports.difficulty_pivot(rows)
    assert pivot.columns == ["position", "model_label", "MATH-500", "AIME-2025"]
    assert [tuple(r)[2:] for r in pivot.collect()][:3] == [(75.0, None), (None, None), (25.0, 50.0)]


def test_grid_and_completeness_show_what_is_missing(spark):
    rows = result_rows(spark)
    grid = [tuple(r) for r in reports.summary_grid(rows).collect()]
    assert len(grid) == 3 * 2
    assert grid[1] == ("Qwen2.5-1.5B", "math500", "25.00%", "1/4")
    assert grid[2] == ("Qwen2.5-Math-7B-Instruct", "aime2025", "MISSING", "")
    status = reports.completeness(rows).first()
    assert (status["expected"], status["found"], status["complete"]) == (12, 5, False)
    full = rows.where(F.col("model") == "Qwen2.5-1.5B").where("prefix_ratio = 1")
    assert reports.completeness(full).first()["complete"] is True


def test_repeated_and_unknown_completions(spark):
    from evalsieve.operators.scoring import completion_faults

    asked = prefix_grid(spark.createDataFrame([("d", 1, "q", "5"), ("d", 2, "q", "6")], QUESTIONS), [1.0])
    made = [("m", "d", 1, 1.0, r"\boxed{5}"), ("m", "d", 1, 1.0, r"\boxed{5}"), ("m", "d", 2, 1.0, "no"), ("m", "d", 9, 1.0, r"\boxed{5}")]
    faults = completion_faults(asked, spark.createDataFrame(made, COMPLETIONS)).collect()
    assert {(r.model, r.id, r.completions, r.asked) for r in faults} == {("m", 1, 2, True), ("m", 9, 1, False)}
    with pytest.raises(ValueError, match="2 completions of one cell"):
        score(asked, spark.createDataFrame(made, COMPLETIONS))
    once = score(asked, spark.createDataFrame(made[1:], COMPLETIONS))
    row = eval_metrics(memorization(once)).first()
    assert (row.total, row.correct, row.accuracy) == (2, 1, 0.5)
    assert completion_faults(asked, spark.createDataFrame(made[1:3], COMPLETIONS)).count() == 0
