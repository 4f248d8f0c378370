"""Small helpers shared by the operators of this folder.

Operators read the columns that they name and take tables with any further ones. Names that
begin with `_llm_` are theirs: they add such columns to a table and drop them again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsieve.scale import settle

#: White space of the word rules: space and the controls from tab to carriage return.
BLANKS = r"\x20\x09-\x0D"


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """`_llm_id` and `_llm_text` name a document for joins: equal rows are one document, also
    without a doc_id; rows that only share a doc_id are not."""
    return docs.withColumns(
        {
            "_llm_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")),
            "_llm_text": F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull()),
        }
    )


#: Bits of the filter that tells which rows may have one of a set of keys: 32 MB at most.
SLOTS = 1 << 28


def parted_by_keys(rows: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have one of the keys, and the others, which have none.

    Rows stay where they are: the keys' hashes are broadcast as a bitmap of a fixed number of
    bits, whatever the number of keys. Where it fills up, more rows are taken to have a key;
    the caller joins those by the key itself.
    """

    def slot():  # Spark counts the bits of bitmaps from 1
        return F.pmod(F.xxhash64(*on), F.lit(SLOTS)) + 1

    bitmaps = keys.select(slot().alias("_llm_slot")).groupBy(
        F.bitmap_bucket_number("_llm_slot").alias("_llm_bucket")
    ).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_llm_slot")).alias("_llm_bits"))
    bitmaps = settle(bitmaps)
    bit = F.bitmap_bit_position(slot())
    byte = F.substring("_llm_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
    is_set = F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), (bit % 8).cast("int")) == 1
    marked = rows.withColumn("_llm_bucket", F.bitmap_bucket_number(slot())).join(
        F.broadcast(bitmaps), "_llm_bucket", "left")
    may = F.coalesce(is_set, F.lit(False))
    return tuple(marked.where(w).select(*rows.columns) for w in (may, ~may))


def with_found(docs: DataFrame, found: DataFrame, on: list[str], empty: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Documents with what was found for their key in a column `name`, and the documents that
    have no such key, with `empty` there. Only the former are shuffled.

    `found` has one settled row per key, so Spark can split a key that very many rows share.
    """
    some, others = parted_by_keys(docs, found, on)
    joined = some.join(found, on, "left").withColumn(name, F.coalesce(name, empty))
    return joined.select(*docs.columns, name), others.withColumn(name, empty)


#: Rows that are Python values at a time.
SLICE = 1000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def map_batches(
    df: DataFrame, fn: Callable[[dict[str, list]], dict[str, Iterable]], schema: str
) -> DataFrame:
    """Apply `fn` to Arrow batches, SLICE rows at a time, as columns of Python values; it may
    give any number of rows."""
    fields = pa.schema(
        [pa.field(f.name, _arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = fn({name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[f.name], type=f.type) for f in fields], schema=fields
            )

    return df.mapInArrow(run, schema)


def rewrite(df: DataFrame, fn: Callable[..., dict[str, list]], needs: list[str], makes: str) -> DataFrame:
    """`df` with the columns that `fn` makes of lists of the needed ones, replaced or added; all
    other columns pass through untouched."""
    made = T._parse_datatype_string(makes).fields
    names = [f.name for f in made]
    replaced = {f.name: f for f in made}
    kept = [replaced.get(f.name, f) for f in df.schema.fields]
    schema = T.StructType([*kept, *[f for f in made if f.name not in df.columns]])
    order = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = fn(*[batch.column(n).to_pylist() for n in needs])
            arrays = [
                pa.array(out[n], type=_arrow_type(replaced[n].dataType)) if n in names else batch.column(n)
                for n in order
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=order)

    return df.mapInArrow(run, schema)


class Spans:
    """Spans of a text, asked again and again whether one of them overlaps another span."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        ordered = sorted(spans)
        self._starts = [a for a, _ in ordered]
        self._reach = list(accumulate((b for _, b in ordered), max))  # furthest end so far

    def touch(self, start: int, end: int) -> bool:
        before = bisect_left(self._starts, end)
        return before > 0 and self._reach[before - 1] > start


def gaps(length: int, spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What ordered spans, some of which may lie in others, leave of a text."""
    at, out = 0, []
    for start, end in spans:
        if start > at:
            out.append((at, start))
        at = max(at, end)
    if length > at:
        out.append((at, length))
    return out


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow_type(f.dataType)) for f in kind.fields])
    return {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
    }[type(kind)]


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of a list of texts of about `most` characters each, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > most:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)
