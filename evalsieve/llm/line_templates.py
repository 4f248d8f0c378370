"""Line dedup by a tree of log templates.

A line falls to the leaf of a fixed-depth tree: its number of tokens, then its leading
tokens, where tokens with digits count as a variable field. In a leaf the tokens of the other
positions are counted over its distinct lines. Of a line's tokens the more frequent ones, by
a given share, are what its format has in common; the rarest of these names the format, the
tokens are counted again among the lines that have it, and those as frequent as the rarest of
the given share make the template. The others are variable fields. So every format of a leaf
gets its template, however many formats and lines the leaf has, and two lines of one template
agree on the leading tokens and on at least that share of the others. All of it is counting,
in two rounds. A leaf of bounded text is counted whole, within a task that sees one leaf after
the other; a larger one by joins and groups over all tasks, with the same verdict.

A template is dropped if it recurs across documents: near-duplicates count as one, and a
template that several groups of them hold recurs, wherever its lines stand. A text that was
merely copied keeps its lines here; whole copies are for the near-duplicate operators.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm import simhash
from evalsieve.llm.common import keyed, map_batches, parted_by_keys, rewrite, with_found
from evalsieve.scale import settle

#: Leading tokens that make the levels of the tree below the number of tokens.
LEADING = 3
#: Share of a line's tokens after the leading ones that its template fixes at least.
AGREEING = 0.6
#: Groups of near-duplicate documents from which a template recurs.
GROUPS = 2

#: Characters of a leaf's lines, repeats included, up to which one task counts it whole.
WHOLE_CHARS = 1_000_000
#: Bits of the filter on leaves.
SLOTS = 1 << 23

_FIELD = re.compile(r"[0-9]")
_DIGITS = b"0123456789"
_VARIABLE = "<*>"


def _hash(data: bytes, seed: int) -> int:
    value = xxhash.xxh64_intdigest(data, seed)
    return value - 2**64 if value >= 2**63 else value


def _masked(line: str) -> bytes:
    """Tokens of a line, those with digits masked, joined by one space."""
    # most lines are that already: printable text has no blank but the space
    if line.isprintable() and "  " not in line and line[:1] != " " and line[-1:] != " ":
        own = line.encode("utf-8")
        if len(own.translate(None, _DIGITS)) == len(own):
            return own
    return " ".join([_VARIABLE if _FIELD.search(t) else t for t in line.split()]).encode("utf-8")


def _tree_path(line: str, leading: int) -> tuple[int, bytes, int] | None:
    """Number of tokens, masked text and leaf of a line; none for one without tokens."""
    masked = _masked(line)
    if not masked:
        return None
    n = masked.count(b" ") + 1
    head = b" ".join(masked.split(b" ", leading)[:leading])
    return n, masked, _hash(b"%d %b" % (n, head), 1)


def lines(docs: DataFrame, leading: int = LEADING) -> DataFrame:
    """Every line with tokens for all levels: its document's key, its number and offsets in the
    text, leaf and a hash of its masked text."""

    names = ("_llm_id", "_llm_text", "line", "start", "end", "leaf", "own")

    def run(columns):
        rows = []
        for key, text_hash, text in zip(columns["_llm_id"], columns["_llm_text"], columns["text"]):
            at = 0
            for number, line in enumerate((text or "").split("\n")):
                path = _tree_path(line, leading)
                if path and path[0] >= leading:
                    rows.append((key, text_hash, number, at, at + len(line), path[2], _hash(path[1], 2)))
                at += len(line) + 1
        return dict(zip(names, zip(*rows) if rows else [[]] * len(names)))

    return map_batches(
        keyed(docs).select("_llm_id", "_llm_text", F.col("text").cast("string").alias("text")), run,
        "_llm_id long, _llm_text long, line int, start long, end long, leaf long, own long",
    )


def _slots(leaves: DataFrame) -> np.ndarray:
    """A bitmap of SLOTS bits of the leaves' hashes; its size does not depend on their number."""
    slot = F.pmod("leaf", F.lit(SLOTS)) + 1  # Spark counts the bits of bitmaps from 1
    bits = np.zeros(SLOTS // 8, dtype=np.uint8)
    rows = leaves.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return bits


def masked_lines(docs: DataFrame, leaves: DataFrame, leading: int = LEADING) -> DataFrame:
    """leaf, own and masked text of the lines of the given leaves, with the leaves' columns;
    repeated lines are left out where they are seen together.

    The texts are parsed again rather than kept: a bitmap of the leaves' hashes lets only
    a few others through, and the join then leaves just these.
    """
    bits = _slots(leaves)

    def run(columns):
        seen: dict[tuple[int, int], bytes] = {}
        for text in columns["text"]:
            for line in (text or "").split("\n"):
                path = _tree_path(line, leading)
                if path:
                    _, masked, leaf = path
                    slot = leaf % SLOTS
                    if bits[slot >> 3] >> (slot & 7) & 1:
                        seen[leaf, _hash(masked, 2)] = masked
        return {"leaf": [k[0] for k in seen], "own": [k[1] for k in seen], "masked": [m.decode("utf-8") for m in seen.values()]}

    found = map_batches(docs.select(F.col("text").cast("string").alias("text")), run, "leaf long, own long, masked string")
    return found.join(leaves, "leaf")


def _edges(rows: list[tuple[str, ...]], agreeing: float) -> Iterator[tuple[list[int], int]]:
    """For each line how many lines have its token, by place, and the leftmost place of the
    count with which the given share of the line is reached."""
    count = Counter(chain.from_iterable(map(enumerate, rows)))
    for tokens in rows:
        n = list(map(count.__getitem__, enumerate(tokens)))
        yield n, n.index(sorted(n, reverse=True)[math.ceil(agreeing * len(n)) - 1])


def _leaf_templates(leaf: int, lines_: dict[int, str], agreeing: float, leading: int) -> Iterator[tuple[int, int]]:
    """own and template of the lines of one leaf that share tokens with others of it."""
    split = {own: tuple(masked.split(" ")[leading:]) for own, masked in lines_.items()}
    formats: dict[tuple[int, str], list[int]] = defaultdict(list)
    if len(split) < 2 or not all(split.values()):  # none, or all, have no further tokens
        return
    for (own, tokens), (n, edge) in zip(split.items(), _edges(list(split.values()), agreeing)):
        if n[edge] > 1:
            formats[edge, tokens[edge]].append(own)
    for named, members in formats.items():
        rows = [split[own] for own in members]
        for own, tokens, (n, edge) in zip(members, rows, _edges(rows, agreeing)):
            if n[edge] > 1:
                fixed = " ".join(f"{at}:{t}" for at, t in enumerate(tokens) if n[at] >= n[edge])
                yield own, _hash(f"{leaf} {named[0]}:{named[1]} {fixed}".encode("utf-8"), 3)


def _by_leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, str]]]:
    """The lines of each leaf, out of batches in the order of leaves."""
    last, rows = None, {}
    for batch in batches:
        for leaf, own, masked in zip(*[batch.column(n).to_pylist() for n in ("leaf", "own", "masked")]):
            if leaf != last:
                if rows:
                    yield last, rows
                last, rows = leaf, {}
            rows[own] = masked
    if rows:
        yield last, rows


def _counted_whole(found: DataFrame, agreeing: float, leading: int) -> DataFrame:
    """leaf, own, template for leaves of bounded text, one at a time in memory."""
    kind = pa.schema([(n, pa.int64()) for n in ("leaf", "own", "template")])

    def run(batches):
        out: list[tuple[int, int, int]] = []
        for leaf, rows in _by_leaf(batches):
            out += [(leaf, *named) for named in _leaf_templates(leaf, rows, agreeing, leading)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=kind)

    return found.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, "leaf long, own long, template long")


def _counted(tokens: DataFrame, agreeing: float) -> DataFrame:
    """leaf, own, most: the tokens (-n, at, key) of every line, n being how many lines have the
    key; the most frequent first, of equals the leftmost. And `edge`, the leftmost of those
    with which the given share of the line is reached."""
    n = tokens.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("n")).where("n > 1")
    # settled, so that both sides are dealt anew and Spark can split a token of very many lines
    with_n = tokens.join(settle(n), "key", "left")
    each = F.struct((-F.coalesce("n", F.lit(1))).alias("n"), "at", "key")
    lines_ = with_n.groupBy("leaf", "own").agg(F.array_sort(F.collect_list(each)).alias("most"))
    reach = F.col("most")[F.ceil(agreeing * F.size("most")).cast("int") - 1]
    return lines_.withColumn("edge", F.filter("most", lambda t: t["n"] == reach["n"])[0])


def _counted_by_joins(found: DataFrame, agreeing: float, leading: int) -> DataFrame:
    """leaf, own, template for leaves of any size."""
    distinct = found.groupBy("leaf", "own").agg(F.first("masked").alias("masked"))
    # a token at its place in its leaf, by a hash
    tokens = settle(
        distinct.select("leaf", "own", F.posexplode(F.split("masked", " ")).alias("at", "token"))
        .where(F.col("at") >= leading)
        .select("leaf", "own", "at", F.xxhash64("leaf", "at", "token").alias("key"))
    )
    named = settle(
        _counted(tokens, agreeing).where(F.col("edge")["n"] < -1)
        .select("leaf", "own", F.inline("most"), F.col("edge")["key"].alias("format"))
        .select("leaf", "own", "at", F.xxhash64("key", "format").alias("key"))
    )
    again = settle(_counted(named, agreeing))
    fixed = F.filter("most", lambda t: t["n"] <= F.col("edge")["n"])
    keys = F.array_sort(F.transform(fixed, lambda t: t["key"]))
    return again.where(F.col("edge")["n"] < -1).select("leaf", "own", F.xxhash64("leaf", keys).alias("template"))


def shared_leaves(found: DataFrame, least: int = GROUPS) -> DataFrame:
    """leaf, `several` distinct lines or one, characters: of the leaves with `least` lines, settled.
    No other could have a template that recurs, as a template has one leaf."""
    return settle(
        found.groupBy("leaf")
        .agg((F.min("own") != F.max("own")).alias("several"), F.count(F.lit(1)).alias("n"),
             F.sum(F.col("end") - F.col("start")).alias("chars"))
        .where(F.col("n") >= least).drop("n")
    )


def templates(docs: DataFrame, found: DataFrame, agreeing: float = AGREEING, least: int = GROUPS,
              leading: int = LEADING, whole: int = WHOLE_CHARS, shared: DataFrame | None = None) -> DataFrame:
    """leaf, own, template: for the distinct lines that share tokens with others of their leaf.

    Only leaves with several distinct lines, and `least` lines, are looked at; `shared` are the
    `shared_leaves`, if known. Leaves of more than `whole` characters are counted by joins.
    """
    if shared is None:
        shared = shared_leaves(found, least)
    many = settle(shared.where("several").select("leaf", (F.col("chars") > whole).alias("large")))
    masked = settle(masked_lines(docs, many, leading))
    parts = [masked.where(w).drop("large") for w in (F.col("large"), ~F.col("large"))]
    return _counted_by_joins(parts[0], agreeing, leading).unionByName(_counted_whole(parts[1], agreeing, leading))


def _in_groups(docs: DataFrame, named: DataFrame, least: int) -> DataFrame:
    """The templates that at least so many groups of near-duplicate documents hold.

    Groups are asked for only of the texts that hold a template of several texts, and of one
    document of each text.
    """
    held = settle(named.groupBy("template", "_llm_text").agg(F.min("_llm_id").alias("_llm_id")))
    several = settle(
        held.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("template"))
    held = settle(held.join(several, "template", "left_semi"))
    own = ["_llm_id", "_llm_text"]
    some, _ = parted_by_keys(keyed(docs), held.select(*own).distinct(), own)
    each = held.join(simhash.groups_of_texts(some), "_llm_text").groupBy("template", "group").agg(F.lit(1).alias("_"))
    return each.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("template")


def recurring_lines(docs: DataFrame, groups: int = GROUPS) -> DataFrame:
    """Key, number, offsets and template of every line whose template recurs across documents."""
    found = settle(lines(docs))
    shared = shared_leaves(found, groups)
    carried = settle(templates(docs, found, least=groups, shared=shared))
    # most lines are alone in their leaf: they are neither joined nor shuffled
    may, _ = parted_by_keys(found, shared.select("leaf"), ["leaf"])
    named = settle(
        may.join(carried.hint("shuffle_hash"), ["leaf", "own"], "left")  # spares sorting the lines
        .withColumn("template", F.coalesce("template", "own")).drop("leaf", "own")
    )
    # settled, so that it is dealt anew for the join and Spark can split a hot template's lines
    recurring = settle(_in_groups(docs, named, groups))
    return named.join(recurring, "template", "left_semi").select(
        "_llm_id", "_llm_text", "line", "start", "end", "template")


def drop_recurring(docs: DataFrame, groups: int = GROUPS, name: str = "dropped") -> DataFrame:
    """`docs` with all columns, `text` without its recurring lines, and `dropped`: line number,
    start, end (code points, end exclusive, of the text as given) and template of each. A
    column of that name is replaced; `name` gives another one.

    Blank lines, and lines with fewer tokens than the tree has levels of them, stay. A null
    text stays null. Equal rows are one document and are cut alike; every row is returned, also
    if nothing is left of its text. An empty table gives an empty one.
    """
    spans = F.struct("line", "start", "end", "template")
    gone = settle(recurring_lines(docs, groups).groupBy("_llm_id", "_llm_text").agg(
        F.array_sort(F.collect_set(spans)).alias(name)))
    empty = F.array().cast("array<struct<line:int,start:bigint,end:bigint,template:bigint>>")
    changed, same = (
        part.drop("_llm_id", "_llm_text")
        for part in with_found(keyed(docs.drop(name)), gone.hint("shuffle_hash"), ["_llm_id", "_llm_text"], empty, name)
    )

    def cut(texts, numbered):
        left = []
        for text, own in zip(texts, numbered):
            if own:
                numbers = set(own)
                text = "\n".join([x for i, x in enumerate(text.split("\n")) if i not in numbers])
            left.append(text)
        return {"text": left}

    numbered = changed.withColumn("_llm_lines", F.col(name)["line"])
    return rewrite(numbered, cut, ["text", "_llm_lines"], "text string").drop("_llm_lines").unionByName(
        same.withColumn("text", F.col("text").cast("string")))
