"""The longest text that an item and a training row share.

A match says that a row holds n words of an item; how long the common run is tells a chance
phrase from a copy. Runs are islands of matching positions on a diagonal (position in the
row less position in the item).

Positions of rows are not joined with positions of items: a row's matching positions form
stretches of text, and a stretch that many rows share, such as a closing phrase, is compared
with the items once. Only the longest run of each (stretch, item) goes back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsieve.functions.text import tokenize
from evalsieve.operators.ngrams import Tokenizer, bench_ngrams, train_hits
from evalsieve.scale import join_lookup, settle


def _islands(positions: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The positions with `island`, equal for those that follow one another within a key."""
    order = Window.partitionBy(*keys).orderBy(at)
    return positions.withColumn("island", F.col(at) - F.row_number().over(order))


def stretches(hits: DataFrame) -> DataFrame:
    """benchmark, train_idx, start, n, words: the stretches of a row in which every position
    starts an n-gram of the benchmark.

    `hits` has the distinct (benchmark, n, ngram, train_idx, train_pos).
    """
    row = ["benchmark", "n", "train_idx"]
    grouped = _islands(hits, row, "train_pos").groupBy(*row, "island").agg(
        F.min("train_pos").alias("start"),
        F.array_sort(F.collect_list(F.struct("train_pos", F.get("ngram", F.lit(0)).alias("word")))).alias("_first"),
        F.max_by("ngram", "train_pos").alias("_last"),
    )
    first = F.transform("_first", lambda p: p["word"])
    rest = F.slice("_last", F.lit(2), F.col("n") - 1)
    return grouped.select("benchmark", "n", "train_idx", F.col("start").cast("long"), F.concat(first, rest).alias("words"))


def _best(runs: DataFrame, keys: list[str], row_start: str) -> DataFrame:
    """The longest run of each key; of equals the first in the row, then in the item."""
    rank: Column = F.struct(F.col("length"), -F.col(row_start), -F.col("test_start"))
    found = runs.groupBy(*keys).agg(F.max(rank).alias("_run"))
    return found.select(
        *keys,
        F.col("_run")["length"].alias("length"),
        (-F.col("_run").getField("col2")).alias(row_start),
        (-F.col("_run").getField("col3")).alias("test_start"),
    )


def longest_runs(
    train: DataFrame, bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """benchmark, test_idx, train_idx, test_start, train_start, length (in tokens): the longest
    run of tokens that each matching pair shares; of equals the first in the row."""
    dictionary = settle(bench_ngrams(bench, n, tokenizer))
    terms = settle(dictionary.select("benchmark", "n", "ngram").distinct())
    hits = train_hits(train, terms, tokenizer=tokenizer).select(
        "benchmark", "n", "ngram", F.col("row_idx").alias("train_idx"), "train_pos")
    named = settle(
        stretches(hits).withColumn("stretch", F.md5(F.concat_ws("\x1f", "benchmark", F.array_join("words", "\x1f")).cast("binary")))
    )
    # equal stretches once, with the n-grams at their places
    distinct = named.groupBy("benchmark", "n", "stretch").agg(F.any_value("words").alias("words"))
    places = distinct.select(
        "benchmark", "n", "stretch", "words",
        F.explode(F.sequence(F.lit(0), F.size("words") - F.col("n"))).alias("at"),
    ).select("benchmark", "n", "stretch", "at", F.slice("words", F.col("at") + 1, F.col("n")).alias("ngram"))
    items = dictionary.select("benchmark", "test_idx", "test_pos", "ngram")
    met = join_lookup(settle(places), items, ["benchmark", "ngram"], spread_by=["stretch", "at"])
    diagonals = met.withColumn("diagonal", F.col("at") - F.col("test_pos"))
    keys = ["benchmark", "stretch", "test_idx", "diagonal"]
    runs = _islands(diagonals, keys, "at").groupBy(*keys, "island").agg(
        (F.count(F.lit(1)) + F.any_value("n") - 1).alias("length"),
        F.min("at").cast("long").alias("at"),
        F.min("test_pos").cast("long").alias("test_start"),
    )
    best = settle(_best(runs, ["benchmark", "stretch", "test_idx"], "at"))
    held = named.select("benchmark", "stretch", "train_idx", "start")
    pairs = join_lookup(held, best, ["benchmark", "stretch"], spread_by=["train_idx", "start"]).withColumn(
        "train_start", F.col("start") + F.col("at"))
    return _best(pairs, ["benchmark", "test_idx", "train_idx"], "train_start").select(
        "benchmark", "test_idx", "train_idx", "test_start", "train_start", "length")
