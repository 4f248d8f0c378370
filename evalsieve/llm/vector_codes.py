"""Vector codes of four bytes: the nearest entry of a codebook for each part of a vector.

The codebooks are learned in rounds over all rows; a round is one pass that adds up, per part
and entry, what was assigned to it, inside the tasks first. The codebooks, of fixed size, are
all that goes to the driver and back.

Nearest entries are found in a geometric tree (GNAT) over a codebook. A node has split points
and shares the other entries out among them, each to the nearest. For every split point it
stores the range of distances to the entries of each subtree. From a query's distances
to the split points and its best distance so far, a subtree is left out if the triangle
inequality puts all of it strictly farther away. Ranges and bounds are rounded apart, so a tie
is never left out, and entries that are reached are compared by whole-number distances.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.scale import settle

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024

#: Split points of a node, and entries below which a node is scanned.
SPLITS = 12
LEAF = 12
#: Components saturate here, so that sums of squares stay exact in 64 bits.
LARGEST = 1 << 26
#: Largest squares sum for which doubles are exact.
_EXACT = float(2**53)
#: Relative slack of a rounded distance, far above what a square root loses.
_SLACK = 1e-9


@dataclass
class _Node:
    own: np.ndarray  # entries that are compared here: split points, or all of a leaf
    low: np.ndarray | None = None  # [split, child]: distances from the split to the child's entries
    high: np.ndarray | None = None
    children: list[_Node | None] = field(default_factory=list)


class Tree:
    """Exact nearest entries of one codebook part; `looked_at` counts compared entries."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries = np.ascontiguousarray(entries, dtype=np.int64)
        self.splits, self.leaf = max(2, splits), max(1, leaf)
        self.looked_at = 0
        self._largest = float(np.abs(self.entries).max(initial=0))
        self._doubles = self.entries.astype(np.float64)
        self._squares = (self._doubles**2).sum(axis=1)
        self._root = self._node(np.arange(len(self.entries)))

    def _between(self, points: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Squared distances as whole numbers, exact as long as 64 bits hold them."""
        largest = max(float(np.abs(points).max(initial=0)), self._largest)
        if 4.0 * largest * largest * max(1, points.shape[1]) < _EXACT:
            p = points.astype(np.float64)
            squares = (p**2).sum(axis=1)[:, None] + self._squares[of][None, :] - 2.0 * (p @ self._doubles[of].T)
            return squares.astype(np.int64)
        out = np.zeros((len(points), len(of)), dtype=np.int64)
        for k in range(points.shape[1]):
            out += (points[:, k, None] - self.entries[of, k][None, :]) ** 2
        return out

    def _node(self, own: np.ndarray) -> _Node:
        if len(own) <= max(self.leaf, self.splits):
            return _Node(own)
        # split points far apart: each time the entry farthest from those chosen
        chosen = [0]
        squares = self._between(self.entries[own], own[:1])
        while len(chosen) < self.splits:
            far = int(squares.min(axis=1).argmax())
            if far in chosen:  # only copies of split points are left
                break
            chosen.append(far)
            squares = np.c_[squares, self._between(self.entries[own], own[[far]])]
        if len(chosen) < 2:
            return _Node(own)
        home = squares.argmin(axis=1)
        distances = np.sqrt(squares.astype(np.float64))
        is_split = np.zeros(len(own), dtype=bool)
        is_split[chosen] = True
        low = np.full((len(chosen), len(chosen)), np.inf)
        high = np.full((len(chosen), len(chosen)), -np.inf)
        children: list[_Node | None] = []
        for c in range(len(chosen)):
            members = np.flatnonzero((home == c) & ~is_split)
            if not len(members):
                children.append(None)
                continue
            low[:, c] = distances[members].min(axis=0) * (1 - _SLACK)
            high[:, c] = distances[members].max(axis=0) * (1 + _SLACK)
            children.append(self._node(own[members]))
        return _Node(own[chosen], low, high, children)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point the nearest entry, of equals the first, and the squared distance."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.full(len(points), len(self.entries), dtype=np.int64)
        if len(points):
            self._search(self._root, points, np.arange(len(points)), best, index)
        return index, best

    def _search(self, node: _Node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        squares = self._between(points[rows], node.own)
        self.looked_at += squares.size
        order = np.argsort(node.own, kind="stable")  # of equal distances the first entry counts
        at = order[squares[:, order].argmin(axis=1)]
        near, entry = squares[np.arange(len(rows)), at], node.own[at]
        better = (near < best[rows]) | ((near == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = near[better], entry[better]
        if not node.children:
            return
        distances = np.sqrt(squares.astype(np.float64))
        closest = distances.argmin(axis=1)
        # first the subtree of the closest split point, then the others with what is known by then
        for turn in (0, 1):
            for c, child in enumerate(node.children):
                if child is None:
                    continue
                mine = np.flatnonzero((closest == c) == (turn == 0))
                radius = np.sqrt(best[rows[mine]].astype(np.float64)) * (1 + _SLACK)
                d = distances[mine]
                apart = np.maximum(node.low[:, c] - d * (1 + _SLACK), d * (1 - _SLACK) - node.high[:, c]).max(axis=1)
                reached = rows[mine[apart <= radius]]
                if len(reached):
                    self._search(child, points, reached, best, index)


def whole_vectors(vectors: DataFrame, scale: int = SCALE, parts: int = PARTS) -> DataFrame:
    """vec_id, label and x = floor(scale * component) of the rows that take part.

    Rows whose vector is null or holds a null or non-finite component are dropped. So are
    vectors that cannot be cut like the others: those whose length is not the most frequent
    one that `parts` divides (of equally frequent ones the greatest). Components saturate at
    2^26, so that sums of squares fit in 64 bits. Without a label column labels are null.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")) & ~F.isnan(v.cast("double")))
    edge = F.lit(float(LARGEST))
    x = F.transform("embedding", lambda v: F.floor(
        F.greatest(-edge, F.least(edge, F.lit(float(scale)) * v.cast("double")))))
    label = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    kept = vectors.where(F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x"))
    lengths = kept.groupBy(F.size("x").alias("n")).agg(F.count(F.lit(1)).alias("rows")).where(
        F.col("n") % parts == 0).agg(F.max_by("n", F.struct("rows", "n")).alias("n")).first()["n"]
    return kept.where(F.size("x") == F.lit(lengths))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.int64).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def _codes(codebooks: list[np.ndarray], trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part, and the squared distances summed over the parts."""
    width = x.shape[1] // len(codebooks)
    found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees)]
    return np.stack([i for i, _ in found], axis=1), sum(d for _, d in found)


def _improved(whole: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one more round over all rows."""
    width = codebooks[0].shape[1]

    def run(batches):
        trees = [Tree(c) for c in codebooks]
        sums = [np.zeros(c.shape, dtype=np.int64) for c in codebooks]
        counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        for batch in batches:
            x = _matrix(batch.column(0))
            codes, _ = _codes(codebooks, trees, x) if len(x) else (np.zeros((0, len(codebooks)), dtype=np.int64), None)
            for p in range(len(codebooks)):
                np.add.at(sums[p], codes[:, p], x[:, p * width : (p + 1) * width])
                counts[p] += np.bincount(codes[:, p], minlength=len(counts[p]))
        used = [(p, int(e)) for p in range(len(codebooks)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()),
             pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
             pa.array([sums[p][e].tolist() for p, e in used], pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    each = whole.select("x").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = (
        each.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at").agg(
            F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))
        .collect()  # a row for each component of the codebooks at most
    )
    after = [c.copy() for c in codebooks]
    for r in totals:
        after[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return after


def train(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook per part, from rows of `whole_vectors`: they start as that part of the rows
    of the smallest vec_ids (of equal ids the smaller vector first, null ids last) and are
    improved in rounds; entries that no row is assigned to stay."""
    first = whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return []
    start = np.array([r["x"] for r in first], dtype=np.int64)
    codebooks = [np.ascontiguousarray(c) for c in np.split(start.reshape(len(first), -1), parts, axis=1)]
    for _ in range(rounds):
        codebooks = _improved(whole, codebooks)
    return codebooks


def assign(whole: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """vec_id, label, codes (an entry per part) and error (squared distance) of every row."""

    def run(batches):
        trees = [Tree(c) for c in codebooks]
        for batch in batches:
            x = _matrix(batch.column(2))
            codes, error = _codes(codebooks, trees, x) if len(x) else (np.zeros((0, 1), dtype=np.int64), np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes.tolist(), pa.list_(pa.int64())), pa.array(error, pa.int64())],
                names=["vec_id", "label", "codes", "error"],
            )

    return whole.select("vec_id", "label", "x").mapInArrow(
        run, "vec_id long, label string, codes array<long>, error long")


def text_of(codebooks: list[np.ndarray]) -> str:
    """All components in decimals by part, entry and position, joined by commas."""
    return ",".join(str(v) for c in codebooks for v in c.reshape(-1).tolist())


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """The coded rows (vec_id, label, codes, error, label_error) and the final codebooks.

    `label_error` is the error summed over the rows of a label, nulls together. Every row that
    takes part is returned, repeated rows each. A null vec_id stays null. An empty table gives
    no rows and no codebooks. Columns besides vec_id, embedding and label are not read.
    """
    whole = settle(whole_vectors(vectors, parts=parts))
    codebooks = train(whole, parts, entries, rounds)
    if not codebooks:
        empty = whole.select("vec_id", "label", F.array().cast("array<bigint>").alias("codes"),
                             F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return empty.limit(0), codebooks
    coded = settle(assign(whole, codebooks))
    # settled, so that the join deals both sides anew and Spark can split a hot label
    sums = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_llm_label"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("_llm_label"))).drop("_llm_label")
    return joined, codebooks
