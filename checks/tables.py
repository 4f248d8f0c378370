"""The given tables in the roles the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsieve.operators.scoring import RATIOS, prefix_grid
from evalsieve.plans.reports import MODEL_LABELS
from evalsieve.scale import spread

MODELS = list(MODEL_LABELS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a training row at position doc_id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("answer"),
        "source",
    )


def training_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, spread over all cores for work on the texts."""
    return spread(training(spark, sf_dir))


def benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two benchmarks, by the parity of the item."""
    return table(spark, sf_dir, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, "bench-even").otherwise("bench-odd").alias("benchmark"),
        F.col("item_id").alias("test_idx"),
        F.col("item_id").cast("string").alias("id"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("answer"),
        F.lit(None).cast("string").alias("source"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One example for every 32 documents, asking the benchmark items in turn."""
    bench = table(spark, sf_dir, "benchmark")
    n_items = bench.select(F.count(F.lit(1))).scalar()
    examples = (
        table(spark, sf_dir, "documents")
        .select(F.floor(F.col("doc_id") / 32).alias("id"))
        .distinct()
        .withColumn("item_id", F.col("id") % n_items)
    )
    number = ((F.col("item_id") * 7) % 1000).cast("string")
    return (
        examples.join(bench, "item_id")
        .withColumn("number", number)
        .select(
            F.when(F.col("item_id") % 2 == 0, "math500").otherwise("aime2025").alias("dataset"),
            "id",
            F.col("text").alias("question"),
            F.when(F.col("id") % 3 == 0, F.concat(F.lit(" $"), "number", F.lit("$. ")))
            .otherwise(F.col("number"))
            .alias("answer"),
            "number",
        )
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is one completion: of one model, at one ratio, for one example.

    Some begin with the hidden tail or a part of it. The ending cycles through
    missing, wrong, correct, nested, repeated and unclosed boxes.
    """
    asked = questions(spark, sf_dir)
    cells = prefix_grid(asked).join(asked.select("id", "number"), "id")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        F.try_element_at(
            F.array(*[F.lit(m) for m in MODELS]), (F.col("doc_id") % 8 + 1).cast("int")
        ).alias("model"),
        (F.col("doc_id") % 8).alias("m"),
        F.floor(F.col("doc_id") / 32).alias("id"),
        F.try_element_at(
            F.array(*[F.lit(r) for r in RATIOS]),
            (F.floor(F.col("doc_id") / 8) % 4 + 1).cast("int"),
        ).alias("ratio"),
        "text",
    )
    number = F.col("number")
    endings = [
        F.lit(""),
        F.concat(F.lit(r" \boxed{0"), number, F.lit("}")),
        F.concat(F.lit(r" \boxed{$"), number, F.lit("$.}")),
        F.concat(F.lit(r" \boxed{\frac{"), number, F.lit("}{2}}")),
        F.concat(F.lit(r" \boxed{1} then \boxed{"), number, F.lit("}")),
        F.concat(F.lit(r" \boxed{ "), number),
        F.concat(F.lit(r" \boxed{\text{ "), number, F.lit(" }}. Done {x}.")),
    ]
    opening = (
        F.when(F.col("id") % 5 == 0, F.concat("tail", F.lit(" ")))
        .when(F.col("id") % 5 == 1, F.concat(F.substring("tail", F.lit(11), F.length("tail")), F.lit(" ")))
        .otherwise("")
    )
    ending = F.try_element_at(
        F.array(*endings), ((F.col("id") + F.col("m")) % len(endings) + 1).cast("int")
    )
    return docs.join(cells, ["id", "ratio"]).select(
        "model", "dataset", "id", "ratio", F.concat(opening, "text", ending).alias("generated")
    )
