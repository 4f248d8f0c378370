"""A lasting index of training rows, for benchmarks that come later.

The index holds the marks of every row's n-grams (see `ngrams.row_marks`), each once, with the
longest n that has it of all that a benchmark may have, as a table bucketed by the mark. A new benchmark meets it by its own marks:
few of them are broadcast, many are shuffled to the buckets, and the index itself is never
shuffled. That leaves the rows that may match, and only their texts are read and compared.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalsieve.functions.text import tokenize
from evalsieve.operators import contamination
from evalsieve.operators.ngrams import (
    LONGEST,
    SHORTEST,
    Tokenizer,
    row_marks,
    settled_terms,
    term_marks,
)
from evalsieve.operators.positions import keep_rows
from evalsieve.scale import fits_broadcast, settle

#: Lengths of n-grams that are indexed, and buckets of the table; both hold for its whole life.
LENGTHS = tuple(range(SHORTEST, LONGEST + 1))
BUCKETS = 64


def _table(spark: SparkSession, folder: str, buckets: int) -> str:
    """The name under which this session knows the table in a folder."""
    name = "row_marks_" + md5(f"{folder} {buckets}".encode()).hexdigest()
    place = folder.replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (n INT, mark BIGINT, row_idx BIGINT) USING parquet "
        f"CLUSTERED BY (mark) INTO {buckets} BUCKETS LOCATION '{place}'"
    )
    return name


def add_rows(
    train: DataFrame,
    folder: str,
    lengths: Sequence[int] = LENGTHS,
    tokenizer: Tokenizer = tokenize,
    buckets: int = BUCKETS,
) -> None:
    """Index rows (row_idx, prompt), beside those that the folder has.

    A row that is added twice does no harm. All rows of an index need the same lengths,
    tokenizer and number of buckets.
    """
    spark = train.sparkSession
    marks = row_marks(train, sorted(lengths), tokenizer=tokenizer).select(
        F.col("n").cast("int").alias("n"), F.col("_mark").alias("mark"), F.col("row_idx").cast("long").alias("row_idx"))
    name = _table(spark, folder, buckets)
    # dealt by the mark first, so that a bucket gets one file and not one from every task
    dealt = marks.repartition(buckets, "mark")
    dealt.write.mode("append").format("parquet").bucketBy(buckets, "mark").option(
        "path", folder).saveAsTable(name)


def candidates(spark: SparkSession, folder: str, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """row_idx of the indexed rows that may hold one of the n-grams; complete, not exact."""
    spark.catalog.refreshTable(_table(spark, folder, buckets))
    index = spark.table(_table(spark, folder, buckets))
    wanted = settle(term_marks(terms).withColumnRenamed("_mark", "mark"))
    met = index.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted.hint("merge"), "mark")
    return met.where(F.col("n") >= F.col("least_n")).select("row_idx").distinct()


def detect(
    train: DataFrame,
    bench: DataFrame,
    folder: str,
    n: int | None = None,
    lengths: Sequence[int] = LENGTHS,
    tokenizer: Tokenizer = tokenize,
    carry: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> contamination.Detection:
    """The same as `contamination.detect`, from the texts of the candidate rows alone.

    `train` must hold the indexed rows at their positions. An n that is not indexed is refused.
    """
    terms = settled_terms(bench, n, tokenizer)
    other = [r["n"] for r in terms.select("n").distinct().collect() if r["n"] not in set(lengths)]
    if other:
        raise ValueError(f"the index has no n-grams of {sorted(other)} words")
    found = settle(candidates(train.sparkSession, folder, terms, buckets))
    rows = keep_rows(train, found.select(F.col("row_idx").alias("train_idx")))
    return contamination.detect(rows, bench, n, tokenizer, carry)
