"""What the matches say about benchmarks and training rows.

`detect` answers all summary questions from one pass over the training rows. It
does not build (item, row) pairs: a phrase shared by a third of the rows and a
third of the items would have far too many. Pairs are built only for the
reports that list them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.functions.text import tokenize
from evalsieve.operators.ngrams import Tokenizer, ngram_length, settled_terms, train_hits
from evalsieve.operators.positions import keep_rows
from evalsieve.scale import join_lookup, settle


@dataclass(frozen=True)
class Detection:
    """Result of one detection pass.

    flagged: one row per (benchmark, train_idx), with the carried columns
    touched: one row per (benchmark, test_idx)
    """

    flagged: DataFrame
    touched: DataFrame

    def flagged_rows(self) -> DataFrame:
        """Rows flagged by any benchmark, once each."""
        return self.flagged.drop("benchmark").distinct()


def detect(
    train: DataFrame,
    bench: DataFrame,
    n: int | None = None,
    tokenizer: Tokenizer = tokenize,
    carry: Sequence[str] = (),
) -> Detection:
    dictionary = settled_terms(bench, n, tokenizer)
    terms = dictionary.select("benchmark", "n", "ngram").distinct()
    hits = train_hits(train, terms, tokenizer=tokenizer, carry=carry)

    # One scan, two groupings. Both collapse inside each task before the shuffle:
    # a row's hits sit in one task, and a hot n-gram becomes one row per task.
    evidence = settle(
        hits.groupingSets(
            [
                [F.col("benchmark"), F.col("row_idx"), *[F.col(c) for c in carry]],
                [F.col("benchmark"), F.col("ngram")],
            ],
            "benchmark",
            "row_idx",
            *carry,
            "ngram",
        ).agg(F.grouping("ngram").alias("_by_row"))
    )
    flagged = evidence.where("_by_row = 1").select(
        "benchmark", F.col("row_idx").alias("train_idx"), *carry
    )
    found = evidence.where("_by_row = 0").select("benchmark", "ngram")
    items = dictionary.select("benchmark", "test_idx", "ngram")
    touched = join_lookup(items, found, ["benchmark", "ngram"], "left_semi", ["test_idx"])
    return Detection(flagged, touched.select("benchmark", "test_idx").distinct())


def contamination_summary(found: Detection, bench: DataFrame) -> DataFrame:
    """Per benchmark: size, contaminated items and rate, contaminated rows.

    Items shorter than their benchmark's n can never be found; `unmatchable_items`
    counts them.
    """
    sizes = bench.groupBy("benchmark").agg(F.count(F.lit(1)).alias("test_size"))
    items = found.touched.groupBy("benchmark").agg(F.count(F.lit(1)).alias("contaminated_test"))
    rows = found.flagged.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("num_contaminated_train")
    )
    joined = sizes.join(items, "benchmark", "left").join(rows, "benchmark", "left")
    return joined.select(
        "benchmark",
        "test_size",
        F.coalesce("contaminated_test", F.lit(0)).alias("contaminated_test"),
        F.coalesce("num_contaminated_train", F.lit(0)).alias("num_contaminated_train"),
    ).withColumn(
        "contamination_rate", F.col("contaminated_test") / F.col("test_size") * 100
    )


def unmatchable_items(
    bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Per benchmark: items that are too short for any n-gram of its length."""
    size = F.size(tokenizer(F.col("prompt")))
    items = bench.select("benchmark", "test_idx", size.alias("_size"))
    if n is None:
        lengths = settle(ngram_length(bench, tokenizer=tokenizer))
        items = join_lookup(items, lengths, ["benchmark"], spread_by=["test_idx"])
    else:
        items = items.withColumn("n", F.lit(n))
    return items.groupBy("benchmark").agg(
        F.sum((F.col("_size") < F.col("n")).cast("long")).alias("unmatchable_test")
    )


def contaminated_indices(found: Detection) -> DataFrame:
    """Flagged positions per benchmark, one per row, in order."""
    return found.flagged.select("benchmark", "train_idx").orderBy("benchmark", "train_idx")


def contamination_total(found: Detection, train: DataFrame) -> DataFrame:
    """Rows flagged by any benchmark, and their share of the training rows."""
    total = found.flagged.select(F.countDistinct("train_idx")).scalar()
    return (
        train.agg(F.count(F.lit(1)).alias("training_size"))
        .withColumn("total_contaminated_train", total)
        .withColumn(
            "contaminated_pct",
            F.try_divide("total_contaminated_train", "training_size") * 100,
        )
    )


def match_sources(pairs: DataFrame) -> DataFrame:
    """Match pairs (not rows) per training source; pairs carry `source`."""
    return pairs.groupBy(F.col("source").alias("train_source")).agg(
        F.count(F.lit(1)).alias("pairs")
    )


def match_details(pairs: DataFrame, train: DataFrame, bench: DataFrame) -> DataFrame:
    """Both sides of every pair: ids, source and full texts.

    The pairs are settled first. Training rows are reduced to the matched ones
    before any text moves, and a row with many partners is spread over tasks.
    """
    pairs = settle(pairs.select("benchmark", "test_idx", "train_idx"))
    matched = keep_rows(
        train.select("row_idx", "id", "source", "prompt"), pairs.select("train_idx").distinct()
    )
    rows = settle(
        matched.select(
            F.col("row_idx").alias("train_idx"),
            F.col("id").alias("train_id"),
            F.col("source").alias("train_source"),
            F.col("prompt").alias("train_prompt"),
        )
    )
    items = bench.select(
        "benchmark", "test_idx", F.col("id").alias("test_id"), F.col("prompt").alias("test_prompt")
    )
    with_items = join_lookup(pairs, items, ["benchmark", "test_idx"], spread_by=["train_idx"])
    return join_lookup(
        with_items, rows, ["train_idx"], spread_by=["benchmark", "test_idx"]
    ).select(
        "benchmark",
        "test_idx",
        "test_id",
        "test_prompt",
        "train_idx",
        "train_id",
        "train_source",
        "train_prompt",
    )
