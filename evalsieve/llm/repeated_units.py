"""Substring dedup by hashed units.

Units are the lines of a text and, in lines of several sentences, the sentences. Each is
normalised (A-Z lowered, blanks collapsed) and digested to 128 bits. Digests are grouped
over the whole corpus; the occurrence in the smallest doc_id, then at the smallest offset,
is kept and all others are removed, with the offsets that they had.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm.common import gaps, keyed, map_batches, rewrite, with_found
from evalsieve.scale import settle

#: Words of a unit at least; shorter ones recur by chance and stay.
UNIT_WORDS = 8

_SENTENCE = re.compile(r"[^.!?]*[.!?]+|[^.!?]+")


def _signed(value: int) -> int:
    return value - 2**64 if value >= 2**63 else value


def units(docs: DataFrame, words: int = UNIT_WORDS) -> DataFrame:
    """Key of the document, offsets and digest of every unit of at least `words` words."""

    def run(columns):
        out: dict[str, list] = {n: [] for n in ("_llm_id", "_llm_text", "start", "end", "high", "low")}

        def add(key, text_hash, start, piece):
            own = piece.encode("utf-8").lower().split()
            if len(own) >= words:
                digest = xxhash.xxh3_128_intdigest(b" ".join(own))
                for name, value in zip(out, (key, text_hash, start, start + len(piece),
                                             _signed(digest >> 64), _signed(digest & (2**64 - 1)))):
                    out[name].append(value)

        for key, text_hash, text in zip(columns["_llm_id"], columns["_llm_text"], columns["text"]):
            at = 0
            for line in (text or "").split("\n"):
                add(key, text_hash, at, line)
                pieces = list(_SENTENCE.finditer(line))
                if len(pieces) > 1:
                    for m in pieces:
                        add(key, text_hash, at + m.start(), m[0])
                at += len(line) + 1
        return out

    return map_batches(
        keyed(docs).select("_llm_id", "_llm_text", F.col("text").cast("string").alias("text")), run,
        "_llm_id long, _llm_text long, start long, end long, high long, low long",
    )


def repeats(docs: DataFrame, words: int = UNIT_WORDS) -> DataFrame:
    """Key and offsets of every unit but the first of its digest, and where the first is."""
    found = settle(units(docs, words))
    place = F.struct("_llm_id", "_llm_text", "start")
    # settled, so that both sides of the join are dealt anew and Spark can split a hot digest
    first = settle(
        found.groupBy("high", "low")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    keeper = F.col("first._llm_id")
    return (
        found.join(first, ["high", "low"])
        .where(place != F.col("first"))
        .select(
            "_llm_id", "_llm_text", "start", "end",
            F.when(keeper != -(2**63), keeper).alias("kept_doc_id"), F.col("first.start").alias("kept_start"),
        )
    )


def remove_repeats(docs: DataFrame, words: int = UNIT_WORDS) -> DataFrame:
    """`docs` with all columns, `text` without its repeated units, `removed` (start, end, and
    the place of the kept occurrence, of each) and `kept` (start and end of what is left).

    All offsets are code points of the text as given, ends exclusive. Equal rows are one
    document. A null text stays null and counts as empty; a null doc_id ranks first. Every
    row is returned, also if nothing is left of its text; an empty table gives an empty one.
    Columns of the names `removed` and `kept` are replaced.
    """
    span = F.struct("start", "end", "kept_doc_id", "kept_start")
    gone = settle(repeats(docs, words).groupBy("_llm_id", "_llm_text").agg(
        F.array_sort(F.collect_set(span)).alias("removed")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kept_doc_id:bigint,kept_start:bigint>>")
    # texts without repeats stay in place
    changed, same = (
        part.drop("_llm_id", "_llm_text")
        for part in with_found(keyed(docs.drop("removed", "kept")), gone, ["_llm_id", "_llm_text"], empty, "removed")
    )

    def cut(texts, removed):
        left, kept = [], []
        for text, spans in zip(texts, removed):
            own = gaps(len(text or ""), [(s["start"], s["end"]) for s in spans])
            left.append("".join([text[a:b] for a, b in own]) if spans else text)
            kept.append([{"start": a, "end": b} for a, b in own])
        return {"text": left, "kept": kept}

    text = F.col("text").cast("string")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.length(text).cast("long").alias("end")))
    return rewrite(
        changed, cut, ["text", "removed"], "text string, kept array<struct<start:long,end:long>>"
    ).unionByName(same.withColumns({"kept": F.filter(whole, lambda span: span["end"] > 0), "text": text}))



SQL = r"""
WITH lines AS (
  SELECT doc_id, line, piece, sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY line) - length(piece) - 1 AS start
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS piece,
          unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents)),
split AS (
  SELECT *, regexp_extract_all(piece, '[^.!?]*[.!?]+|[^.!?]+') AS parts FROM lines),
parts AS (
  SELECT doc_id, line, part, piece, lone, start
    + sum(length(piece)) OVER (PARTITION BY doc_id, line ORDER BY part) - length(piece) AS start
  FROM (SELECT doc_id, line, start, unnest(parts) AS piece, unnest(range(len(parts))) AS part, len(parts) = 1 AS lone
        FROM split)),
units AS (
  SELECT doc_id, line, NULL AS part, piece, start FROM lines
  UNION ALL SELECT doc_id, line, part, piece, start FROM parts WHERE NOT lone),
worded AS (
  SELECT *, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM units),
ranked AS (
  SELECT *, min((doc_id, start)) OVER (PARTITION BY array_to_string(words, ' ')) AS first FROM worded WHERE len(words) >= 8),
gone AS (
  SELECT doc_id, line, part, start::BIGINT AS start, (start + length(piece))::BIGINT AS stop,
    first[1] AS kept_doc_id, first[2]::BIGINT AS kept_start
  FROM ranked WHERE first <> (doc_id, start)),
left_lines AS (
  SELECT l.doc_id, l.line, CASE WHEN g.line IS NOT NULL THEN '' ELSE coalesce(p.piece, '') END AS piece
  FROM lines l LEFT JOIN (SELECT DISTINCT doc_id, line FROM gone WHERE part IS NULL) g USING (doc_id, line)
  LEFT JOIN (
    SELECT q.doc_id, q.line, string_agg(q.piece, '' ORDER BY q.part) AS piece FROM parts q
    LEFT JOIN gone h ON h.doc_id = q.doc_id AND h.line = q.line AND h.part = q.part
    WHERE h.doc_id IS NULL GROUP BY q.doc_id, q.line) p USING (doc_id, line)),
texts AS (SELECT doc_id, string_agg(piece, chr(10) ORDER BY line) AS text FROM left_lines GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_removed, string_agg(start || ':' || stop || ':' || kept_doc_id || ':' || kept_start, ','
    ORDER BY start, stop) AS removed
  FROM (SELECT DISTINCT doc_id, start, stop, kept_doc_id, kept_start FROM gone) GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed, text
FROM texts LEFT JOIN listed USING (doc_id)
"""
