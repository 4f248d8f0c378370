"""Decisions that depend on data size: what to broadcast, how to salt, where to cut.

Settings, read from the session at call time:

  spark.evalsieve.broadcastRows    largest side, in rows, that is ever broadcast
  spark.evalsieve.broadcastBytes   the same in bytes of values
  spark.evalsieve.keyRows          rows of one join key from which it is split
  spark.checkpoint.dir             shared folder for cut lineage
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = "spark.evalsieve.broadcastRows"
BROADCAST_BYTES = "spark.evalsieve.broadcastBytes"
KEY_ROWS = "spark.evalsieve.keyRows"

_DEFAULTS = {BROADCAST_ROWS: 4_000_000, BROADCAST_BYTES: 256 * 1024 * 1024, KEY_ROWS: 1_000_000}

#: Settled tables of the jobs that are running, innermost last.
_SCOPES: list[list[str]] = []


def limit_of(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="evalsieve-"))
        folder = context.getCheckpointDir()
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: written to the shared folder and read back.

    The table outlives any executor, has known sizes, and later steps read only
    the columns they need. It stays, under the name of the application, until the
    folder is cleaned, or until the job ends that made it (see `settled_tables`).
    """
    spark = df.sparkSession
    application = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/evalsieve-{application}/{uuid4()}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settled_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of a job, the tables that were settled in it.

    What the job returns must not depend on them: it reads back what it has written.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for path in _SCOPES.pop():
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def _value_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.StringType):
        size = F.octet_length(c) + 16
    elif isinstance(field.dataType, T.BinaryType):
        size = F.octet_length(c) + 16
    elif isinstance(field.dataType, T.ArrayType) and isinstance(
        field.dataType.elementType, T.StringType
    ):
        size = F.octet_length(F.array_join(c, "")) + 16 * F.size(c)
    else:
        size = F.lit(16)
    return F.coalesce(size.cast("long"), F.lit(16).cast("long"))


def measure(df: DataFrame, *extra: Column) -> Row:
    """Rows and value bytes of a side, with further aggregates, in one job."""
    row_bytes = sum((_value_bytes(f) for f in df.schema.fields), F.lit(0).cast("long"))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"),
        *extra,
    ).first()


def is_small(spark: SparkSession, size: Row) -> bool:
    return size["rows"] <= limit_of(spark, BROADCAST_ROWS) and size["bytes"] <= limit_of(
        spark, BROADCAST_BYTES
    )


def fits_broadcast(df: DataFrame) -> bool:
    """Measure a side against the broadcast limits."""
    return is_small(df.sparkSession, measure(df))


def salted_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, spread_by: Sequence[str]
) -> DataFrame:
    """Shuffle join that splits the hot keys of `rows` over many tasks.

    The rows of a key are counted first; a key with more than `keyRows` of them gets as
    many parts as that takes, and only its lookup rows are copied. `spread_by` names
    columns that differ within one key. Each row meets exactly one copy of the lookup, so
    inner, left, semi and anti joins keep their meaning. `rows` is read twice: settle it
    if it is costly.
    """
    most = limit_of(rows.sparkSession, KEY_ROWS)
    parts = F.ceil(F.col("_n") / most).cast("bigint")
    # at most one key for every `most` rows
    hot = settle(
        rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
        .select(*on, parts.alias("_parts"))
    )
    if not hot.head(1):
        return rows.join(lookup, list(on), how)
    marked = [df.join(F.broadcast(hot), list(on), "left") for df in (rows, lookup)]
    whole = F.coalesce("_parts", F.lit(1).cast("bigint"))
    salted = marked[0].withColumn("_salt", F.pmod(F.xxhash64(*spread_by), whole)).drop("_parts")
    copies = marked[1].withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1))
    ).drop("_parts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Join a large side with a side that is usually small.

    The lookup is broadcast if it was measured to fit. Otherwise both sides are
    shuffled, salted by `spread_by`; leave it out where `on` is unique in `rows`.
    The lookup is read twice, so settle it if it is costly.
    """
    on = list(on)
    if fits_broadcast(lookup):
        return rows.join(F.broadcast(lookup), on, how)
    if not spread_by:
        # hashing the lookup spares sorting the rows
        return rows.join(lookup.hint("shuffle_hash"), on, how)
    return salted_join(rows, lookup, on, how, spread_by)


def spread(df: DataFrame) -> DataFrame:
    """Give a scan of few files at least one task per core; no shuffle otherwise.

    Meant for plain scans: it asks for the number of scan partitions.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def draw(seed: int, key: Column | str) -> Column:
    """A reproducible random text per row key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw_bucket(value: Column | str) -> Column:
    """One of 65,536 equal ranges of draws, in draw order."""
    value = F.col(value) if isinstance(value, str) else value
    return F.conv(F.substring(value, 1, 4), 16, 10).cast("int")


def rank_by_draw(df: DataFrame, drawn: str, key: str, name: str) -> DataFrame:
    """Global position (from 0) in draw order, without sorting in one task.

    Rows are ranked inside each draw range; the range sizes, at most 65,536
    rows, give every range its offset.
    """
    ranged = df.withColumn("_range", draw_bucket(drawn))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_range").orderBy(drawn, key)
    return (
        ranged.withColumn("_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_offset") + F.col("_in")).cast("long"))
        .drop("_range", "_in", "_offset")
    )
