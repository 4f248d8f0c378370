"""Report tables over result rows (model, dataset, prefix_ratio, accuracy, ...).

Result rows are aggregates: one per model, dataset and ratio.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsieve.scale import settle

# Display label of every model.
MODEL_LABELS = {
    "Llama-3.1-8B-Instruct": "Llama 3.1-8B (Teacher)",
    "Llama-3.2-1B-Instruct": "Llama 3.2-1B (Base)",
    "llama_instruct_from_llama_merged": "Llama 3.2-1B (Student)",
    "llama_from_qwen_merged": "Llama 3.2-1B (Cross-Family)",
    "Qwen2.5-Math-7B-Instruct": "Qwen2.5-Math-7B (Teacher)",
    "Qwen2.5-1.5B": "Qwen2.5-1.5B (Base)",
    "qwen_from_qwen_merged": "Qwen2.5-1.5B (Student)",
    "qwen_from_llama_merged": "Qwen2.5-1.5B (Cross-Family)",
}

# Display name of every dataset, in column order.
DATASET_LABELS = {"math500": "MATH-500", "aime2025": "AIME-2025"}

# Models of one family, in display order.
FAMILIES = {
    "Llama": ["Llama 3.1-8B (Teacher)", "Llama 3.2-1B (Base)", "Llama 3.2-1B (Student)"],
    "Qwen": ["Qwen2.5-Math-7B (Teacher)", "Qwen2.5-1.5B (Base)", "Qwen2.5-1.5B (Student)"],
}

# Row order of the difficulty table.
DIFFICULTY_ROWS = [
    "Qwen2.5-Math-7B (Teacher)",
    "Qwen2.5-1.5B (Student)",
    "Qwen2.5-1.5B (Base)",
    "Llama 3.1-8B (Teacher)",
    "Llama 3.2-1B (Student)",
    "Llama 3.2-1B (Base)",
]

MAIN_DATASET = "math500"


def _label(labels: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col("model")).alias("model_label")


def _full_prompt(results: DataFrame, dataset: str) -> DataFrame:
    return results.where((F.col("dataset") == dataset) & (F.col("prefix_ratio") == 1.0))


def _ordered_list(results: DataFrame, **columns: Sequence) -> DataFrame:
    """A short literal table, one row per position of the given lists."""
    rows = F.arrays_zip(
        *[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in columns.items()]
    )
    return results.sparkSession.range(1).select(F.inline(rows))


def model_comparison(
    results: DataFrame, dataset: str = MAIN_DATASET, labels: Mapping[str, str] = MODEL_LABELS
) -> DataFrame:
    """Accuracy at the full prompt, lowest first."""
    return (
        _full_prompt(results, dataset)
        .select(
            "model",
            _label(labels),
            (F.col("accuracy") * 100).alias("accuracy_pct"),
            "correct",
            "total",
        )
        .orderBy("accuracy_pct", "model")
    )


def accuracy_curve(
    results: DataFrame, dataset: str = MAIN_DATASET, labels: Mapping[str, str] = MODEL_LABELS
) -> DataFrame:
    """Accuracy against the shown share, per model."""
    return (
        results.where(F.col("dataset") == dataset)
        .select(
            "model",
            _label(labels),
            "prefix_ratio",
            (F.col("accuracy") * 100).alias("accuracy_pct"),
        )
        .orderBy("model", "prefix_ratio")
    )


def family_transfer(
    results: DataFrame,
    dataset: str = MAIN_DATASET,
    families: Mapping[str, Sequence[str]] = FAMILIES,
    labels: Mapping[str, str] = MODEL_LABELS,
) -> DataFrame:
    """Teacher, base and student of every family; null where a model has no result."""
    wanted = _ordered_list(
        results,
        family=[f for f, members in families.items() for _ in members],
        position=[i for members in families.values() for i in range(len(members))],
        model_label=[m for members in families.values() for m in members],
    )
    measured = _full_prompt(results, dataset).select(
        _label(labels), (F.col("accuracy") * 100).alias("accuracy_pct")
    )
    return (
        wanted.join(measured, "model_label", "left")
        .select("family", "position", "model_label", "accuracy_pct")
        .orderBy("family", "position")
    )


def format_quality(
    results: DataFrame, dataset: str = MAIN_DATASET, labels: Mapping[str, str] = MODEL_LABELS
) -> DataFrame:
    """Share of completions with and without a boxed answer."""
    return (
        _full_prompt(results, dataset)
        .select(
            "model",
            _label(labels),
            ((1 - F.col("no_boxed_ratio")) * 100).alias("valid_boxed_pct"),
            (F.col("no_boxed_ratio") * 100).alias("no_boxed_pct"),
        )
        .orderBy("valid_boxed_pct", "model")
    )


def memorization_curve(
    results: DataFrame, dataset: str = MAIN_DATASET, labels: Mapping[str, str] = MODEL_LABELS
) -> DataFrame:
    """ROUGE-L of the hidden tail against the shown share; the full prompt has no tail."""
    return (
        results.where((F.col("dataset") == dataset) & (F.col("prefix_ratio") != 1.0))
        .select("model", _label(labels), "prefix_ratio", "avg_rougeL_f")
        .orderBy("model", "prefix_ratio")
    )


def difficulty_pivot(
    results: DataFrame,
    rows: Sequence[str] = DIFFICULTY_ROWS,
    datasets: Mapping[str, str] = DATASET_LABELS,
    labels: Mapping[str, str] = MODEL_LABELS,
) -> DataFrame:
    """Model by dataset accuracy at the full prompt, in the given row order."""
    accuracy = (
        results.where(F.col("prefix_ratio") == 1.0)
        .select(_label(labels), "dataset", (F.col("accuracy") * 100).alias("accuracy_pct"))
        .groupBy("model_label")
        .pivot("dataset", list(datasets))
        .agg(F.first("accuracy_pct"))
        .withColumnsRenamed(dict(datasets))
    )
    order = _ordered_list(results, position=range(len(rows)), model_label=rows)
    return (
        order.join(accuracy, "model_label", "left")
        .select("position", "model_label", *[F.col(f"`{d}`") for d in datasets.values()])
        .orderBy("position")
    )


def summary_grid(results: DataFrame) -> DataFrame:
    """Every model with every dataset at the full prompt; MISSING without a result.

    The result rows are used three times, so they are settled first; they are few.
    """
    results = settle(results)
    datasets = results.select(F.array_sort(F.collect_set("dataset"))).scalar()
    grid = results.select("model").distinct().withColumn("dataset", F.explode(datasets))
    measured = results.where(F.col("prefix_ratio") == 1.0).select(
        "model", "dataset", "accuracy", "correct", "total"
    )
    return (
        grid.join(measured, ["model", "dataset"], "left")
        .select(
            "model",
            "dataset",
            F.coalesce(
                F.concat(F.format_number(F.col("accuracy") * 100, 2), F.lit("%")),
                F.lit("MISSING"),
            ).alias("accuracy"),
            F.coalesce(
                F.concat(F.col("correct").cast("string"), F.lit("/"), F.col("total").cast("string")),
                F.lit(""),
            ).alias("correct_total"),
        )
        .orderBy("model", "dataset")
    )


def completeness(results: DataFrame) -> DataFrame:
    """Result rows found, against models x datasets x ratios."""
    return results.agg(
        F.countDistinct("model").alias("models"),
        F.countDistinct("dataset").alias("datasets"),
        F.countDistinct("prefix_ratio").alias("ratios"),
        F.count(F.lit(1)).alias("found"),
    ).select(
        "*",
        (F.col("models") * F.col("datasets") * F.col("ratios")).alias("expected"),
        (F.col("found") == F.col("models") * F.col("datasets") * F.col("ratios")).alias("complete"),
    )
