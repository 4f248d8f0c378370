"""Keeping or dropping rows by a set of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsieve.scale import (
    BROADCAST_BYTES,
    BROADCAST_ROWS,
    fits_broadcast,
    is_small,
    limit_of,
    measure,
    settle,
)


def _filter(rows: DataFrame, positions: DataFrame, keep: bool) -> DataFrame:
    """Rows stay where they are. The positions are broadcast: as a list, or, one bit per
    position, as bitmaps; where these are too many for one broadcast, the rows are read in
    several turns, each with the bitmaps of one range of positions.
    """
    how = "left_semi" if keep else "left_anti"
    if fits_broadcast(positions):
        return rows.join(F.broadcast(positions), "row_idx", how)
    bitmaps = positions.groupBy(F.bitmap_bucket_number("row_idx").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("row_idx")).alias("_bits")
    )
    bitmaps = settle(bitmaps)
    bit = F.bitmap_bit_position("row_idx")
    byte = F.substring("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (bit % 8).cast("int")) == 1
    marked = rows.withColumn("_bucket", F.bitmap_bucket_number("row_idx"))

    def turn(bits: DataFrame, within: Column | None) -> DataFrame:
        return (
            (marked if within is None else marked.where(within))
            .join(F.broadcast(bits), "_bucket", "inner" if keep else "left")
            .where(is_set if keep else F.col("_bits").isNull() | ~is_set)
            .drop("_bucket", "_bits")
        )

    spark = rows.sparkSession
    size = measure(bitmaps, F.min("_bucket").alias("first"), F.max("_bucket").alias("last"))
    if is_small(spark, size):
        return turn(bitmaps, None)
    # a bitmap has 4 KB
    in_turn = max(1, min(limit_of(spark, BROADCAST_ROWS), limit_of(spark, BROADCAST_BYTES) // 4200))
    edges = list(range(size["first"], size["last"] + 1, in_turn))
    result = None
    for i, start in enumerate(edges):
        inside = F.col("_bucket") >= start if i or keep else F.lit(True)  # the first and last turn are open
        if i + 1 < len(edges):
            inside &= F.col("_bucket") < edges[i + 1]
        part = turn(bitmaps.where(inside), inside)
        result = part if result is None else result.unionByName(part)
    return result


def keep_rows(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows whose row_idx is among the distinct train_idx of `positions`."""
    return _filter(rows, positions.select(F.col("train_idx").alias("row_idx")), keep=True)


def drop_rows(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows whose row_idx is not among the distinct train_idx of `positions`."""
    return _filter(rows, positions.select(F.col("train_idx").alias("row_idx")), keep=False)
