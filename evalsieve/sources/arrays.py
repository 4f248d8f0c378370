"""JSON arrays of objects, one file read by many tasks.

Spark's text reader cuts a file at byte ranges and gives the text between closing braces. What
such a piece does to a reader's state is known without what stands before it, for each of two
cases, inside a string or not: whether it turns the case, how far it opens or closes objects,
and how many top-level objects it ends. These effects compose, so each range of a file is
summed up on its own; a prefix over one row per range gives every range its starting state,
and the ranges are then read again, each by its own task. Objects that lie in one range are
parsed there; only the ends of objects that cross a border are shuffled and put together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalsieve.scale import join_lookup, settle

_ESCAPED = re.compile(r"\\.", re.DOTALL)
_STRING = re.compile(r'"[^"]*"')
_END = re.compile(r"\s*(\[\s*)?\]\s*\}")
#: Deeper nesting is no object that Spark's parser reads.
_DEEPEST = 1000


def effects(piece: str) -> tuple[int, int, int]:
    """Of a piece and the brace after it: whether it turns the case inside / outside of a
    string (1 or 0), and the change of depth if it starts outside and if it starts inside."""
    bare = _ESCAPED.sub("", piece) if "\\" in piece else piece
    quotes = bare.count('"')
    changes = []
    for inside in (0, 1):
        rest = bare
        if inside:
            rest = rest.partition('"')[2]
        rest = _STRING.sub("", rest).partition('"')[0]
        ends_inside = (quotes + inside) % 2
        changes.append(rest.count("{") - (0 if ends_inside else 1))
    return quotes % 2, changes[0], changes[1]


class Cursor:
    """State of a reader between pieces: inside a string, depth, and objects that have ended."""

    def __init__(self, inside: int = 0, depth: int = 0, ended: int = 0):
        self.inside, self.depth, self.ended = inside, depth, ended

    def step(self, piece: str) -> bool:
        """Read a piece and the brace after it; whether that ends a top-level object."""
        turn, outside, inside = effects(piece)
        change = inside if self.inside else outside
        self.inside ^= turn
        if not self.inside and self.depth + change < 0:  # what follows the last object
            return False
        self.depth += change
        if self.depth == 0 and not self.inside:
            self.ended += 1
            return True
        return False


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    scan = spark.read.option("lineSep", "}").text(paths if isinstance(paths, str) else list(paths))
    return scan.select(
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.col("value"),
    )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: how it turns the case; for both cases the change of depth, and the depths at
    the ends of pieces outside of strings, with their numbers, which tell how many objects end
    once the starting depth is known."""
    out: dict[tuple[str, int], list] = {}
    for batch in batches:
        for path, start, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
            state = out.setdefault((path, start), [0, [0, 0], [{}, {}]])
            turn, *changes = effects(value)
            for case in (0, 1):
                inside = case ^ state[0]
                state[1][case] += changes[inside]
                if not inside ^ turn and -_DEEPEST <= state[1][case] <= 0:
                    ends = state[2][case]
                    ends[state[1][case]] = ends.get(state[1][case], 0) + 1
            state[0] ^= turn
    keys = list(out)
    pairs = pa.list_(pa.struct([("depth", pa.int64()), ("n", pa.int64())]))

    def ends(case):
        return pa.array([[{"depth": d, "n": n} for d, n in out[k][2][case].items()] for k in keys], pairs)

    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
         pa.array([out[k][0] for k in keys], pa.int32()),
         pa.array([out[k][1][0] for k in keys], pa.int64()), pa.array([out[k][1][1] for k in keys], pa.int64()),
         ends(0), ends(1)],
        names=["_path", "_start", "turn", "change0", "change1", "ends0", "ends1"],
    )


_SUMMED = (
    "_path string, _start long, turn int, change0 long, change1 long, "
    "ends0 array<struct<depth:long,n:long>>, ends1 array<struct<depth:long,n:long>>"
)


def _starts(pieces: DataFrame) -> DataFrame:
    """_path, _start, and the state at the start of every range: one row a range."""
    sums = settle(pieces.mapInArrow(_summed, _SUMMED))
    before = Window.partitionBy("_path").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(column):
        return F.coalesce(F.sum(column).over(before), F.lit(0).cast("long"))

    cased = sums.withColumn("inside", (prefix("turn") % 2).cast("int"))
    change = F.when(F.col("inside") == 1, F.col("change1")).otherwise(F.col("change0"))
    deep = cased.withColumn("change", change).withColumn("depth", prefix("change"))
    ends = F.when(F.col("inside") == 1, F.col("ends1")).otherwise(F.col("ends0"))
    zero = F.filter(ends, lambda e: e["depth"] + F.col("depth") == 0)
    n = F.coalesce(F.get(zero, F.lit(0))["n"], F.lit(0))
    return deep.withColumn("n", n).select(
        "_path", "_start", "inside", "depth", prefix("n").alias("ended"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects, the parts of those that cross the border of a range, and for the end of
    an array a row without a place."""
    cursor, key, begun, buffer, rows = Cursor(), None, False, [], []

    def leave():
        if buffer:
            text = "".join(buffer)
            buffer.clear()
            if cursor.inside or cursor.depth:
                rows.append((key[0], cursor.ended, key[1], text))
            elif _END.fullmatch(text):
                rows.append((key[0], None, None, None))
            else:  # only the end of a file stands after a brace and before none
                raise ValueError(f"{key[0]} is no array of objects: it ends in {text[-40:-1]!r}")

    def made():
        columns = list(zip(*rows)) if rows else [[]] * 4
        rows.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["_path", "_at", "_range", "text"],
        )

    for batch in batches:
        for path, start, value, inside, depth, ended in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if (path, start) != key:
                leave()
                if inside is None:
                    raise ValueError(f"{path} changed while it was read")
                key, cursor = (path, start), Cursor(inside, depth, ended)
                begun = not inside and not depth  # nothing of an object stands before
            buffer.append(value + "}")
            if cursor.step(value):
                rows.append((path, cursor.ended - 1, None if begun else start, "".join(buffer)))
                buffer.clear()
                begun = True
        yield made()
    leave()
    yield made()


def read_array_rows(spark: SparkSession, paths: str | Sequence[str], schema: str) -> DataFrame:
    """The objects of files that each hold one JSON array, with `_path` and `_at`, the place in
    the array from 0.

    A file may be of any size, on one line or many. An array that ends before its time, or
    whose elements do not parse, fails the job. The files are read twice.
    """
    pieces = _pieces(spark, paths)
    starts = settle(_starts(pieces))
    # one row for each range of spark.sql.files.maxPartitionBytes: some 800,000 for 100 TB
    placed = pieces.join(F.broadcast(starts), ["_path", "_start"], "left")
    cut = settle(
        placed.select("_path", "_start", "value", "inside", "depth", "ended")
        .mapInArrow(_cut, "_path string, _at long, _range long, text string")
    )
    open_ = cut.groupBy("_path").agg(F.count_if(F.col("_at").isNull()).alias("ends")).where("ends <> 1").first()
    if open_:
        raise ValueError(f"{open_['_path']} is no array of objects: it does not end")
    whole = cut.where("_at is not null and _range is null").select("_path", "_at", "text")
    parts = cut.where("_range is not null").groupBy("_path", "_at").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_range", "text"))), lambda p: p["text"]), "").alias("text"))
    opening = F.when(F.col("_at") == 0, F.lit(r"\A[\s\x{FEFF}]*\[\s*")).otherwise(F.lit(r"\A\s*,\s*"))
    bare = F.regexp_replace(F.col("text"), opening, F.lit(""))
    fault = F.raise_error(F.concat(F.lit("no object at the start of "), F.substring(bare, 1, 80)))
    checked = F.when(bare.startswith("{"), bare).otherwise(fault.cast("string"))
    parsed = F.from_json(checked, schema, {"mode": "FAILFAST"})
    objects = whole.unionByName(parts)
    return objects.select("_path", "_at", parsed.alias("_row")).select("_path", "_at", "_row.*")


def number_array_rows(rows: DataFrame, name: str = "row_idx") -> DataFrame:
    """Rows of `read_array_rows` numbered from 0 over all files, in the order of their paths."""
    before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file
    shifts = rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n")).select(
        "_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    return join_lookup(rows, settle(shifts), ["_path"], spread_by=["_at"]).withColumn(
        name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_path", "_at", "_shift")
