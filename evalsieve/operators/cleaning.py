"""Removing flagged rows, reporting on it, and checking the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.functions.text import tokenize
from evalsieve.operators.contamination import Detection, contamination_summary, detect
from evalsieve.operators.ngrams import Tokenizer
from evalsieve.operators.positions import drop_rows
from evalsieve.scale import settle


def decontaminate(train: DataFrame, flagged: DataFrame) -> DataFrame:
    """Training rows whose position is not flagged; `flagged` holds one train_idx per
    removed row."""
    return drop_rows(train, flagged)


def clean_indices(train: DataFrame, flagged: DataFrame) -> DataFrame:
    """Positions that survive; only the position column is read."""
    return decontaminate(train.select("row_idx"), flagged)


def source_counts(train: DataFrame) -> DataFrame:
    return train.groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


def decontamination_report(train: DataFrame, flagged: DataFrame) -> DataFrame:
    """Per source: original, clean and removed rows with their shares.

    `flagged` has one row per removed row and carries its source, so the report
    needs the source column of the training set and no join with it.
    """
    original = train.groupBy("source").agg(F.count(F.lit(1)).alias("original"))
    removed = flagged.groupBy("source").agg(F.count(F.lit(1)).alias("removed"))
    # null-safe, so that rows without a source are reported as well
    counts = original.join(
        removed, original["source"].eqNullSafe(removed["source"]), "left"
    ).select(
        original["source"],
        "original",
        (F.col("original") - F.coalesce("removed", F.lit(0))).alias("clean"),
        F.coalesce("removed", F.lit(0)).alias("removed"),
    )
    counts = settle(counts)  # one row a source; the totals are sums of them
    rows = counts.select(F.sum("original")).scalar()
    kept = counts.select(F.sum("clean")).scalar()
    return counts.select(
        "source",
        "original",
        "clean",
        "removed",
        (F.try_divide("original", rows) * 100).alias("original_pct"),
        F.coalesce(F.try_divide("clean", kept) * 100, F.lit(0.0)).alias("clean_pct"),
        (F.try_divide("removed", "original") * 100).alias("removed_pct"),
    )


def verify(
    train: DataFrame, bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> tuple[DataFrame, DataFrame]:
    """Detect again on a cleaned set: results per benchmark, and the totals."""
    found = detect(train, bench, n, tokenizer)
    per_benchmark = contamination_summary(found, bench).withColumnRenamed(
        "num_contaminated_train", "contaminated_train"
    )
    return per_benchmark, verification_totals(per_benchmark, found)


def verification_totals(per_benchmark: DataFrame, found: Detection) -> DataFrame:
    """Sum of contaminated items, and of the rows both the largest benchmark's
    count and the true union. Clean means that no benchmark has an item left."""
    union = found.flagged.select(F.countDistinct("train_idx")).scalar()
    return per_benchmark.agg(
        F.count(F.lit(1)).alias("benchmarks"),
        F.sum("contaminated_test").alias("contaminated_test"),
        F.max("contaminated_train").alias("contaminated_train_max"),
        F.bool_and(F.col("contaminated_test") == 0).alias("all_clean"),
    ).withColumn("contaminated_train_union", union)
