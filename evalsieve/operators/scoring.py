"""Partial prompts, and scores of the completions they led to.

All models, datasets and ratios are scored in one DataFrame keyed by
(model, dataset, id, ratio).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.functions.overlap import f_measure, lcs_length, overlap_tokens, token_count
from evalsieve.functions.text import (
    boxed,
    build_prompt,
    first_words,
    normalize_answer,
    prefix,
    tail,
    words,
)
from evalsieve.scale import join_lookup, settle

# The shares of a question that are shown.
RATIOS = (1.0, 0.8, 0.6, 0.4)


def prefix_grid(questions: DataFrame, ratios: Sequence[float] = RATIOS) -> DataFrame:
    """Every question at every ratio: the shown part, the hidden tail, the prompt.

    Questions have (dataset, id, question, answer).
    """
    descending = F.array(*[F.lit(float(r)) for r in sorted(ratios, reverse=True)])
    return (
        questions.select("dataset", "id", "question", "answer", F.explode(descending).alias("ratio"))
        .withColumn("shown", prefix("question", F.col("ratio")))
        .withColumn("tail", tail("question", "shown"))
        .withColumn("tail_length", F.length("tail"))
        .withColumn("prompt", build_prompt("shown"))
    )


#: What names a completion.
COMPLETION_KEY = ["model", "dataset", "id", "ratio"]


def completion_faults(grid: DataFrame, completions: DataFrame) -> DataFrame:
    """model, dataset, id, ratio, completions, asked: the keys with several completions, and
    those that no cell of the grid asks for. Keys alone are read, not texts."""
    made = completions.groupBy(*COMPLETION_KEY).agg(F.count(F.lit(1)).alias("completions"))
    cells = grid.select("dataset", "id", "ratio", F.lit(True).alias("_asked")).distinct()
    asked = F.coalesce("_asked", F.lit(False))
    return (
        made.join(cells, ["dataset", "id", "ratio"], "left")
        .where((F.col("completions") > 1) | ~asked)
        .select(*COMPLETION_KEY, "completions", asked.alias("asked"))
    )


def score(grid: DataFrame, completions: DataFrame, settled: bool = False) -> DataFrame:
    """Answers, correctness and format of every cell of the grid, for every model.

    Completions have (model, dataset, id, ratio, generated) and meet their prompt
    by key. A model that has completions of a dataset answers for all its cells: a
    missing completion counts as an empty one, neither correct nor boxed, because
    shares are of the examples asked. Without completions a dataset has no rows of
    that model. Repeated completions of a cell would count twice, so they are refused;
    those that no cell asks for are left out (`completion_faults` lists both). The
    completions are computed once, unless the caller has `settled` them.
    """
    made = completions.select(*COMPLETION_KEY, "generated")
    made = made if settled else settle(made)
    repeated = made.groupBy(*COMPLETION_KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated:
        raise ValueError(f"{repeated['n']} completions of one cell: {repeated.asDict()}")
    cells = grid.select("dataset", "id", "ratio", "answer", "shown", "tail", "tail_length")
    # one row a dataset, with the models that ran on it
    runs = settle(made.groupBy("dataset").agg(F.array_sort(F.collect_set("model")).alias("_models")))
    asked = (
        join_lookup(cells, runs, ["dataset"], spread_by=["id", "ratio"])
        .withColumn("model", F.explode("_models"))
        .drop("_models")
    )
    joined = asked.join(made, COMPLETION_KEY, "left").withColumn(
        "generated", F.coalesce("generated", F.lit(""))
    )
    return (
        joined.withColumn("pred_answer_raw", boxed("generated"))
        .withColumn("pred_answer_norm", normalize_answer("pred_answer_raw"))
        .withColumn("gold_answer_norm", normalize_answer("answer"))
        .select(
            "model",
            "dataset",
            "id",
            "ratio",
            F.col("answer").alias("gold_answer_raw"),
            "gold_answer_norm",
            F.col("shown").alias("truncated_question"),
            "pred_answer_raw",
            "pred_answer_norm",
            (
                (F.col("pred_answer_norm") != "")
                & (F.col("pred_answer_norm") == F.col("gold_answer_norm"))
            ).alias("correct"),
            (F.col("pred_answer_raw") == "").alias("no_boxed"),
            F.length("generated").alias("generated_length"),
            F.col("tail_length").alias("gold_tail_length"),
            "tail",
            "generated",
        )
    )


def memorization(scored: DataFrame) -> DataFrame:
    """Add ROUGE-L of the hidden tail against as many words of the completion."""
    tail_words = F.size(words("tail"))
    cut = F.array_join(first_words("generated", tail_words), " ")
    hidden = F.when(F.col("gold_tail_length") > 0, overlap_tokens("tail")).otherwise(F.lit(""))
    guess = F.when(F.col("gold_tail_length") > 0, overlap_tokens(cut)).otherwise(F.lit(""))
    return (
        scored.withColumn("_hidden", hidden)
        .withColumn("_guess", guess)
        .withColumn("lcs", lcs_length(F.col("_hidden"), F.col("_guess")))
        .withColumn("tail_tokens", token_count(F.col("_hidden")))
        .withColumn("guess_tokens", token_count(F.col("_guess")))
        .withColumn(
            "rougeL_f", f_measure(F.col("lcs"), F.col("tail_tokens"), F.col("guess_tokens"))
        )
        .drop("_hidden", "_guess", "tail", "generated")
    )


def eval_metrics(scored: DataFrame) -> DataFrame:
    """Result rows: one per model, dataset and ratio."""
    return (
        scored.groupBy("model", "dataset", F.col("ratio").alias("prefix_ratio"))
        .agg(
            F.sum(F.col("correct").cast("long")).alias("correct"),
            F.count(F.lit(1)).alias("total"),
            F.avg("rougeL_f").alias("avg_rougeL_f"),
            F.sum(F.col("no_boxed").cast("long")).alias("no_boxed_count"),
        )
        .select(
            "model",
            "dataset",
            "prefix_ratio",
            (F.col("correct") / F.col("total")).alias("accuracy"),
            "correct",
            "total",
            "avg_rougeL_f",
            "no_boxed_count",
            (F.col("no_boxed_count") / F.col("total")).alias("no_boxed_ratio"),
        )
    )


def predictions(scored: DataFrame) -> DataFrame:
    """One row per example with its results in a map by ratio, for output.

    A group holds one row per ratio, so the map stays as small as the ratio list.
    """
    result = F.struct(
        "truncated_question",
        "pred_answer_raw",
        "pred_answer_norm",
        "correct",
        "generated_length",
        "rougeL_f",
        "gold_tail_length",
    )
    entry = F.struct(F.col("ratio").cast("string").alias("key"), result.alias("value"))
    return scored.groupBy(
        "model", "dataset", "id", "gold_answer_raw", "gold_answer_norm"
    ).agg(F.map_from_entries(F.collect_list(entry)).alias("per_prefix"))


def metrics_records(
    results: DataFrame,
    max_new_tokens: int = 2048,
    temperature: float = 0.0,
    engine: str = "spark",
    model_ids: Mapping[str, str] | None = None,
    data_paths: Mapping[str, str] | None = None,
) -> DataFrame:
    """Result rows as one record of maps per model and dataset, for output.

    All ratios share their examples, so a record has one `num_examples`. `model_ids` and
    `data_paths` give the full names; without one, the short name stands in.
    """

    def full(column: str, names: Mapping[str, str] | None):
        known = F.create_map(*[F.lit(v) for pair in (names or {}).items() for v in pair])
        return F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)) if names else F.col(column)

    def by_ratio(value: str, name: str):
        entry = F.struct(F.col("prefix_ratio").cast("string").alias("key"), F.col(value).alias("value"))
        return F.map_from_entries(F.collect_list(entry)).alias(name)

    return results.groupBy("model", "dataset").agg(
        F.first("total").alias("num_examples"),
        F.sort_array(F.collect_list("prefix_ratio"), asc=False).alias("prefix_ratios"),
        by_ratio("correct", "correct_counts"),
        by_ratio("accuracy", "accuracies"),
        by_ratio("avg_rougeL_f", "avg_rougeL_f"),
        by_ratio("no_boxed_count", "no_boxed_counts"),
        by_ratio("no_boxed_ratio", "no_boxed_ratios"),
        F.lit(max_new_tokens).cast("long").alias("max_new_tokens"),
        F.lit(float(temperature)).alias("temperature"),
        F.lit(engine).alias("inference_engine"),
    ).withColumns({"model_id": full("model", model_ids), "data_path": full("dataset", data_paths)})


def flatten_metrics(records: DataFrame) -> DataFrame:
    """Metric records back to one result row per ratio."""
    key = F.col("prefix_ratio").cast("string")
    return records.withColumn("prefix_ratio", F.explode("prefix_ratios")).select(
        "model",
        "dataset",
        "prefix_ratio",
        F.try_element_at("accuracies", key).alias("accuracy"),
        F.try_element_at("correct_counts", key).alias("correct"),
        F.col("num_examples").alias("total"),
        F.try_element_at("avg_rougeL_f", key).alias("avg_rougeL_f"),
        F.try_element_at("no_boxed_counts", key).alias("no_boxed_count"),
        F.try_element_at("no_boxed_ratios", key).alias("no_boxed_ratio"),
    )
