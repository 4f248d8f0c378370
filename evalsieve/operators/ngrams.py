"""N-gram matching of training rows against benchmark items.

The benchmark side becomes a dictionary of n-grams. Training rows are read once
and never shuffled while the dictionary's start hashes fit a broadcast:

  tokens -> one row per position -> hash of the first few tokens -> broadcast
  join with the dictionary's start hashes -> full n-gram of the few survivors
  -> join with the dictionary on the n-gram itself

The hash only discards positions; a match is always decided by comparing the
tokens. Expected columns: train (row_idx, prompt, ...), bench (benchmark,
test_idx, prompt, ...).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsieve.functions.text import tokenize
from evalsieve.operators.positions import keep_rows
from evalsieve.scale import (
    fits_broadcast,
    is_small,
    join_lookup,
    measure,
    salted_join,
    settle,
)

# N is the 5th percentile of item lengths, held within 8 to 13.
SHORTEST, LONGEST, LENGTH_PERCENTILE = 8, 13, 0.05

# Tokens hashed at every position of a training text.
START_TOKENS = 4

# Hashes of token runs that are looked through at a time; more only if one row has more.
_RUNS = 1_000_000

Tokenizer = Callable[[Column], Column]


def ngram_length(
    bench: DataFrame,
    lo: int = SHORTEST,
    hi: int = LONGEST,
    pct: float = LENGTH_PERCENTILE,
    tokenizer: Tokenizer = tokenize,
) -> DataFrame:
    """One n per benchmark, from the length profile of its items."""
    n_tokens = F.size(tokenizer(F.col("prompt")))
    return (
        bench.select("benchmark", n_tokens.alias("n_tokens"))
        .groupBy("benchmark")
        .agg(F.percentile("n_tokens", F.lit(float(pct))).alias("p"))
        .select(
            "benchmark",
            F.greatest(F.lit(lo), F.least(F.lit(hi), F.floor("p").cast("int"))).alias("n"),
        )
    )


def _positions(df: DataFrame, keep: Sequence[str], text: str, tokenizer: Tokenizer) -> DataFrame:
    """One row per token position, with the token array at hand.

    The outer form keeps Spark from adding a filter that would tokenise twice.
    """
    return df.select(*keep, tokenizer(F.col(text)).alias("_tokens")).select(
        *keep, "_tokens", F.posexplode_outer("_tokens").alias("pos", "_token")
    )


def _start_hash(tokens: Column, pos: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(tokens, pos + i) for i in range(width)])


def ngrams(
    df: DataFrame, keep: Sequence[str], text: str, n: Column | int, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """All n-grams as (keep..., pos, ngram); texts shorter than n give none."""
    n = F.lit(n) if isinstance(n, int) else n
    return (
        _positions(df, keep, text, tokenizer)
        .where(F.col("pos") + n <= F.size("_tokens"))
        .select(*keep, "pos", F.slice("_tokens", F.col("pos") + 1, n).alias("ngram"))
    )


def bench_ngrams(
    bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Dictionary (benchmark, test_idx, test_pos, n, ngram)."""
    items = bench.select("benchmark", "test_idx", "prompt")
    if n is None:
        # one row per benchmark
        lengths = settle(ngram_length(bench, tokenizer=tokenizer))
        items = join_lookup(items, lengths, ["benchmark"], spread_by=["test_idx"])
    else:
        items = items.withColumn("n", F.lit(n))
    keep = ["benchmark", "test_idx", "n"]
    return ngrams(items, keep, "prompt", F.col("n"), tokenizer).withColumnRenamed("pos", "test_pos")


def settled_terms(
    bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Distinct (benchmark, test_idx, n, ngram), computed once: it is measured,
    broadcast and joined several times, and is small beside the training rows."""
    grams = bench_ngrams(bench, n, tokenizer).select("benchmark", "test_idx", "n", "ngram")
    return settle(grams.distinct())


def _run_hashes(tokens: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.size(tokens) - width), lambda i: _start_hash(tokens, i, width)
    )


def row_marks(
    train: DataFrame,
    lengths: Sequence[int],
    key: str = "row_idx",
    text: str = "prompt",
    tokenizer: Tokenizer = tokenize,
    width: int = START_TOKENS,
) -> DataFrame:
    """(key, n, _mark): the distinct marks of every row, n being the greatest of the lengths
    whose n-grams have it; those of the shorter lengths have it too.

    Every n-gram is marked by the smallest hash of the `width`-token runs inside it. Equal
    n-grams have equal marks, and neighbouring n-grams mostly share theirs, so a row has far
    fewer marks than positions. The mark of an n-gram also marks a shorter one inside it, so
    all lengths together have no more marks than the shortest alone.
    """
    spans = np.array(sorted(set(lengths))) - width + 1  # runs in an n-gram
    # no filter on the size of short texts, as Spark would tokenise for it once more
    runs_of = F.when(F.size("_tokens") >= min(lengths), _run_hashes(F.col("_tokens"), width))
    rows = train.select(key, tokenizer(F.col(text)).alias("_tokens")).select(
        key, F.coalesce(runs_of, F.array().cast("array<bigint>")).alias("_runs")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, runs = batch.columns
            ends = np.asarray(runs.offsets)[1:]
            at = 0
            while at < len(runs):
                most = (ends[at - 1] if at else np.asarray(runs.offsets)[0]) + _RUNS
                upto = max(at + 1, int(np.searchsorted(ends, most, side="right")))
                part = runs.slice(at, upto - at)
                row, span, mark = _least_runs(part.flatten().to_numpy(), part.value_lengths().to_numpy(), spans)
                n = pa.array(span + (width - 1), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row + at)), n, pa.array(mark)], names=[key, "n", "_mark"])
                at = upto

    made = T.StructType([rows.schema[key], T.StructField("n", T.IntegerType()), T.StructField("_mark", T.LongType())])
    return rows.mapInArrow(run, made)


def _least_runs(runs: np.ndarray, sizes: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, span, hash: the distinct run hashes of each row that are the smallest of some stretch
    of runs, with the greatest of the given spans of such a stretch. `runs` has all rows' hashes."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    reach = np.ones(len(runs), dtype=np.int64)
    for step in (-1, 1):  # how far no smaller hash follows on either side, within the row
        alive = np.arange(len(runs))
        for k in range(1, int(spans[-1])):
            other = alive + step * k
            inside = (other >= 0) & (other < len(runs))
            alive, other = alive[inside], other[inside]
            alive = alive[(row[other] == row[alive]) & (runs[other] >= runs[alive])]
            reach[alive] += 1
    own = np.flatnonzero(reach >= spans[0])
    span = spans[np.searchsorted(spans, reach[own], side="right") - 1]
    row, mark = row[own], runs[own]
    order = np.lexsort((-span, mark, row))
    row, mark, span = row[order], mark[order], span[order]
    first = np.ones(len(row), dtype=bool)
    first[1:] = (row[1:] != row[:-1]) | (mark[1:] != mark[:-1])
    return row[first], span[first], mark[first]


def term_marks(dictionary: DataFrame, width: int = START_TOKENS) -> DataFrame:
    """(_mark, least_n): the marks of a dictionary's n-grams and the shortest that has each."""
    mark = F.array_min(_run_hashes(F.col("ngram"), width))
    return dictionary.groupBy(mark.alias("_mark")).agg(F.min("n").alias("least_n"))


def _shared_window_rows(
    train: DataFrame,
    dictionary: DataFrame,
    lengths: Sequence[int],
    key: str,
    text: str,
    tokenizer: Tokenizer,
    width: int,
) -> DataFrame:
    """Keys of the rows that may hold a dictionary n-gram; complete, not exact.

    Used when the dictionary is too large to broadcast: rows and n-grams meet by their marks.
    """
    marked = row_marks(train, lengths, key, text, tokenizer, width)
    wanted = term_marks(dictionary, width)
    met = join_lookup(marked, wanted, ["_mark"], spread_by=[key])
    return met.where(F.col("n") >= F.col("least_n")).select(key).distinct()


def train_hits(
    train: DataFrame,
    dictionary: DataFrame,
    key: str = "row_idx",
    text: str = "prompt",
    tokenizer: Tokenizer = tokenize,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Training positions whose n-gram is in the dictionary.

    Returns (key, carry..., train_pos) with all dictionary columns. The dictionary
    should be settled; it has a column `n` of few distinct values.
    """
    size = measure(dictionary, F.collect_set("n").alias("lengths"))
    lengths = sorted(size["lengths"]) or [LONGEST]
    width = min(START_TOKENS, lengths[0])
    keep = [key, *carry]

    starts = dictionary.select(
        _start_hash(F.col("ngram"), F.lit(0), width).alias("_start"), "n"
    ).distinct()
    whole_fits = is_small(dictionary.sparkSession, size)
    if whole_fits or fits_broadcast(starts):
        likely = (
            _positions(train, keep, text, tokenizer)
            .withColumn("_start", _start_hash(F.col("_tokens"), F.col("pos"), width))
            .join(F.broadcast(starts), "_start")
        )
    else:
        candidates = settle(
            _shared_window_rows(train, dictionary, lengths, key, text, tokenizer, width)
        )
        # the candidates are broadcast, so the texts stay where they are
        named = train.select(F.col(key).alias("row_idx"), *[c for c in (*carry, text) if c != key])
        rows = keep_rows(named, candidates.select(F.col(key).alias("train_idx"))).withColumnRenamed("row_idx", key)
        likely = _positions(rows, keep, text, tokenizer).withColumn(
            "n", F.explode(F.array(*[F.lit(n) for n in lengths]))
        )
    survivors = likely.where(F.col("pos") + F.col("n") <= F.size("_tokens")).select(
        *keep,
        F.col("pos").alias("train_pos"),
        F.slice("_tokens", F.col("pos") + 1, F.col("n")).alias("ngram"),
    )
    if whole_fits:
        return survivors.join(F.broadcast(dictionary), "ngram")
    return salted_join(settle(survivors), dictionary, ["ngram"], "inner", [key, "train_pos"])


def ngram_matches(
    train: DataFrame, bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """Every matching position pair, with the shared text."""
    dictionary = settle(bench_ngrams(bench, n, tokenizer))
    hits = train_hits(train, dictionary, tokenizer=tokenizer)
    return hits.select(
        "benchmark",
        "test_idx",
        F.array_join("ngram", " ").alias("ngram"),
        F.col("test_pos").cast("long"),
        F.col("row_idx").alias("train_idx"),
        F.col("train_pos").cast("long"),
    )


def contamination_matches(
    train: DataFrame,
    bench: DataFrame,
    n: int | None = None,
    tokenizer: Tokenizer = tokenize,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Distinct (benchmark, test_idx, train_idx) pairs that share an n-gram.

    `carry` adds training columns, such as the source, without a later join.
    """
    dictionary = settled_terms(bench, n, tokenizer)
    shared = row_terms(train, dictionary, tokenizer, carry)
    items = dictionary.select("benchmark", "test_idx", "ngram")
    pairs = join_lookup(shared, items, ["benchmark", "ngram"], spread_by=["train_idx"])
    return pairs.select("benchmark", "test_idx", "train_idx", *carry).distinct()


def row_terms(
    train: DataFrame, dictionary: DataFrame, tokenizer: Tokenizer = tokenize, carry: Sequence[str] = ()
) -> DataFrame:
    """The distinct benchmark n-grams of every row, before any item is joined to them."""
    terms = dictionary.select("benchmark", "n", "ngram").distinct()
    hits = train_hits(train, terms, tokenizer=tokenizer, carry=carry)
    return settle(
        hits.select("benchmark", "ngram", F.col("row_idx").alias("train_idx"), *carry).distinct()
    )


def pairs_per_source(
    train: DataFrame, bench: DataFrame, n: int | None = None, tokenizer: Tokenizer = tokenize
) -> DataFrame:
    """train_source and its number of (item, row) pairs, without making the pairs.

    Rows of a source with the same n-grams have the same items, so they are counted
    together and the items of their n-grams are looked up once.
    """
    dictionary = settled_terms(bench, n, tokenizer)
    shared = row_terms(train, dictionary, tokenizer, ["source"])
    gram = F.struct("benchmark", "ngram")
    # the n-grams of one row, as one key
    alike = settle(
        shared.groupBy("source", "train_idx").agg(F.array_sort(F.collect_set(gram)).alias("_grams"))
        .groupBy("source", "_grams").agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_set", F.sha2(F.to_json("_grams"), 256))
    )
    sets = alike.select("_set", F.inline("_grams")).distinct()
    items = dictionary.select("benchmark", "test_idx", "ngram")
    met = join_lookup(sets, items, ["benchmark", "ngram"], spread_by=["_set"])
    numbers = met.groupBy("_set").agg(F.countDistinct("benchmark", "test_idx").alias("_items"))
    return (
        alike.select("source", "_set", "_rows").join(numbers, "_set")
        .groupBy(F.col("source").alias("train_source"))
        .agg(F.sum(F.col("_rows") * F.col("_items")).alias("pairs"))
    )
