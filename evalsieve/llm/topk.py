"""Exact top-k search by inner product, with block-at-a-time pruning.

The searched rows lie in blocks of consecutive rows, each with its highest and lowest value
of every component. For a query these give a bound on any score in a block; blocks are
visited from the highest bound down, each scored through its forward index, until a bound
falls below the k-th best score so far. Blocks come in ranges and queries in chunks, both
of bounded size; a task searches a few ranges for a few chunks, and the best of every task
are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalsieve.scale import settle

K = 20
#: Rows of a block, of a range, and queries of a chunk.
BLOCK = 512
RANGE = 8192
CHUNK = 512
#: Ranges and chunks that a task gets on average.
TASK_RANGES = 4
TASK_CHUNKS = 16

_PACKED = "number long, n int, ids binary, vectors binary"


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and the components as floor(scale * x), without vectors that are null, empty, or
    hold a null or non-finite component, or have no vec_id."""
    x = F.transform("embedding", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    return vectors.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite
    ).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Consecutive rows of each input split, up to `rows` of them in one binary row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, ids, values = TaskContext.get().partitionId() << 32, 0, [], []

        def row(n):
            nonlocal made
            width = max(map(len, values[:n]))
            block = np.zeros((n, width), dtype="<i8")
            for i, v in enumerate(values[:n]):
                block[i, : len(v)] = v
            made += 1
            out = [base + made, n, np.array(ids[:n], dtype="<i8").tobytes(), block.tobytes()]
            del ids[:n], values[:n]
            return pa.RecordBatch.from_arrays(
                [pa.array([out[0]], pa.int64()), pa.array([out[1]], pa.int32()),
                 pa.array([out[2]], pa.binary()), pa.array([out[3]], pa.binary())],
                names=["number", "n", "ids", "vectors"],
            )

        for batch in batches:
            ids += batch.column(0).to_pylist()
            values += batch.column(1).to_pylist()
            while len(ids) >= rows:
                yield row(rows)
        if ids:
            yield row(len(ids))

    return vectors.mapInArrow(run, _PACKED)


def _unpack(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(b, dtype="<i8") for b in rows["ids"]]
    parts = [np.frombuffer(b, dtype="<i8").reshape(n, -1) for b, n in zip(rows["vectors"], rows["n"])]
    width = max(p.shape[1] for p in parts)
    parts = [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]
    return np.concatenate(ids), np.concatenate(parts)


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray,
           k: int = K, block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each query the ids and scores of its k best rows, best first, ties by smaller id.

    Shorter vectors count as filled up with zeros.
    """
    width = max(vectors.shape[1], queries.shape[1])
    vectors = np.pad(vectors, ((0, 0), (0, width - vectors.shape[1])))
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    largest = float(np.abs(vectors).max()) * float(np.abs(queries).max()) * width
    if largest < 2**53:  # doubles are exact, and faster
        vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    starts = np.arange(0, len(ids), block)
    high = np.maximum.reduceat(vectors, starts, axis=0)
    low = np.minimum.reduceat(vectors, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    ahead = np.take_along_axis(bounds, order, axis=1)

    n = len(query_ids)
    best_ids = [np.zeros(0, dtype=np.int64)] * n
    best = [np.zeros(0, dtype=vectors.dtype)] * n
    kth = np.full(n, -np.inf)
    alive = np.arange(n)
    for turn in range(len(starts)):
        alive = alive[ahead[alive, turn] >= kth[alive]]  # an equal score may have a smaller id
        if not len(alive):
            break
        wanted = order[alive, turn]
        for b in np.unique(wanted).tolist():
            own = alive[wanted == b]
            at = slice(starts[b], starts[b] + block)
            scores = queries[own] @ vectors[at].T
            possible = scores >= kth[own, None]
            possible &= ids[at][None, :] != query_ids[own, None]
            for row, q in enumerate(own.tolist()):
                some = np.flatnonzero(possible[row])
                if not len(some):
                    continue
                all_ids = np.r_[best_ids[q], ids[at][some]]
                all_scores = np.r_[best[q], scores[row, some]]
                first = np.lexsort((all_ids, -all_scores))[:k]
                best_ids[q], best[q] = all_ids[first], all_scores[first]
                if len(first) == k:
                    kth[q] = best[q][-1]
    return [(i, s.astype(np.int64)) for i, s in zip(best_ids, best)]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of `vectors` for each query.

    Both tables have vec_id and x (whole numbers, whose products must fit in 64 bits). Rows
    with the query's own vec_id are left out; repeated rows of `vectors` count one by one,
    equal queries are answered once. An empty table on either side gives no rows.
    """
    ranges = settle(_pack(vectors, RANGE))
    chunks = settle(_pack(queries.distinct(), CHUNK))
    range_groups = max(1, -(-ranges.count() // TASK_RANGES))
    chunk_groups = max(1, -(-chunks.count() // TASK_CHUNKS))

    def deal(df, own, groups, other, copies):
        return df.withColumn(own, F.pmod(F.xxhash64("number"), F.lit(groups)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = deal(ranges, "r", range_groups, "c", chunk_groups)
    right = deal(chunks, "c", chunk_groups, "r", range_groups)

    def run(some_ranges: pd.DataFrame, some_chunks: pd.DataFrame) -> pd.DataFrame:
        out = {"chunk": [], "place": [], "query_id": [], "vec_id": [], "score": []}
        if len(some_ranges) and len(some_chunks):
            some_ranges = some_ranges.sort_values("number")
            ids, rows = _unpack(some_ranges)
            for i in range(len(some_chunks)):
                chunk = some_chunks.iloc[i : i + 1]
                query_ids, own = _unpack(chunk)
                for place, (found, scores) in enumerate(search(ids, rows, query_ids, own, k)):
                    out["chunk"] += [int(chunk["number"].iloc[0])] * len(found)
                    out["place"] += [place] * len(found)
                    out["query_id"] += [int(query_ids[place])] * len(found)
                    out["vec_id"] += found.tolist()
                    out["score"] += scores.tolist()
        return pd.DataFrame(out)

    found = left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(
        run, "chunk long, place long, query_id long, vec_id long, score long")
    best = Window.partitionBy("chunk", "place").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
