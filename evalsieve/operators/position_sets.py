"""Sets of row positions as bitmaps: one 64-bit word for up to 64 neighbouring positions.

A set is a table (set, word, bits): position p is bit p % 64 of the word p div 64. Words
without a bit are left out. Sets merge by `or`, also across jobs, and set algebra joins words,
never positions, so a dense set moves a sixty-fourth of its positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsieve.scale import settle

WORD_BITS = 64


def from_positions(rows: DataFrame, position: str, name: str | Column) -> DataFrame:
    """The sets of the positions (from 0), one per value of `name`; repeats do no harm."""
    label = F.col(name) if isinstance(name, str) else name
    at = F.col(position).cast("long")
    bit = F.expr(f"shiftleft(1L, cast(pmod(cast(`{position}` as bigint), {WORD_BITS}) as int))")
    return rows.where(at.isNotNull()).groupBy(label.alias("set"), F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def positions(sets: DataFrame) -> DataFrame:
    """set, position: the positions of every set."""
    bits = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(WORD_BITS - 1)),
                    lambda i: F.when(F.getbit("bits", i) == 1, F.col("word") * WORD_BITS + i)),
        lambda p: p.isNotNull(),
    )
    return sets.select("set", F.explode(bits).alias("position"))


def sizes(sets: DataFrame) -> DataFrame:
    """set, size: the number of positions of every set that has some."""
    return sets.groupBy("set").agg(F.sum(F.bit_count("bits")).cast("long").alias("size"))


def union_all(sets: DataFrame, name: str, members: Sequence[str] | None = None) -> DataFrame:
    """One set, of the given name, of what any of the member sets (by default all) holds."""
    some = sets if members is None else sets.where(F.col("set").isin(list(members)))
    return some.groupBy(F.lit(name).alias("set"), "word").agg(F.bit_or("bits").alias("bits"))


def intersect_all(sets: DataFrame, name: str, members: Sequence[str]) -> DataFrame:
    """One set of what all of the member sets hold."""
    members = sorted(set(members))
    some = sets.where(F.col("set").isin(members)).groupBy("word").agg(
        F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("_n"))
    return some.where((F.col("_n") == len(members)) & (F.col("bits") != 0)).select(
        F.lit(name).alias("set"), "word", "bits")


def minus(sets: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """One set of what the first set holds and the second does not."""
    other = sets.where(F.col("set") == second).select("word", F.col("bits").alias("_other"))
    left = sets.where(F.col("set") == first).join(other, "word", "left")
    bits = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_other", F.lit(0).cast("long"))))
    return left.select(F.lit(name).alias("set"), "word", bits.alias("bits")).where("bits <> 0")


def overlaps(sets: DataFrame, names: DataFrame) -> DataFrame:
    """set_a, set_b (a < b), size_a, size_b, in_both, only_a, only_b, in_either for every two of the
    `names` (a column `set`), also for sets without positions.

    Words meet on their number, at most as many rows as there are sets; the sets are few.
    """
    sets = settle(sets)
    names = names.select("set").distinct()
    a = sets.select("word", F.col("set").alias("set_a"), F.col("bits").alias("_a"))
    b = sets.select("word", F.col("set").alias("set_b"), F.col("bits").alias("_b"))
    both = (
        a.join(b, "word").where(F.col("set_a") < F.col("set_b"))
        .groupBy("set_a", "set_b").agg(F.sum(F.bit_count(F.col("_a").bitwiseAND(F.col("_b")))).alias("in_both"))
    )
    known = names.join(sizes(sets), "set", "left").select("set", F.coalesce("size", F.lit(0).cast("long")).alias("size"))
    # one entry a set
    listed = known.agg(F.array_sort(F.collect_list(F.struct("set", "size"))).alias("all"))
    pairs = (
        listed.select("all", F.posexplode("all").alias("at", "a"))
        .select("a", F.explode(F.slice("all", F.col("at") + 2, F.size("all"))).alias("b"))
        .select(F.col("a.set").alias("set_a"), F.col("a.size").alias("size_a"),
                F.col("b.set").alias("set_b"), F.col("b.size").alias("size_b"))
    )
    shared = F.coalesce("in_both", F.lit(0)).cast("long")
    return pairs.join(both, ["set_a", "set_b"], "left").select(
        "set_a", "set_b", "size_a", "size_b",
        shared.alias("in_both"),
        (F.col("size_a") - shared).alias("only_a"),
        (F.col("size_b") - shared).alias("only_b"),
        (F.col("size_a") + F.col("size_b") - shared).alias("in_either"),
    )
