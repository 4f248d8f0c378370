"""Quality rules whose cutoffs follow the data of each language and source.

Every metric of every document goes into a log-linear histogram, a quantile sketch that
merges by adding counts: a value keeps its six leading bits, so a quantile is exact to
one part in 32. Sketches are kept per language and source and merged upwards, to the
language and to the whole corpus, for groups with too few documents. A metric's fences
lie a number of spreads away from the group's median; the spread of a metric that hardly
varies is held at a least value, so that clean groups lose nothing. Only DataFrame
functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalsieve.llm.common import BLANKS
from evalsieve.scale import settle

_BLANK_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
#: Documents that a group needs for fences of its own.
GROUP_DOCS = 200
#: Spreads between the median and a fence.
SPREADS = 6


@dataclass(frozen=True)
class Rule:
    """A metric in thousandths, its least spread, and the sides that are fenced."""

    name: str
    least_spread: int
    low: bool = False


#: Symbols, repeated words, repeated lines and characters for each word or line.
RULES = (
    Rule("symbols", 17),
    Rule("repeats", 50),
    Rule("dup_lines", 60),
    Rule("word_length", 250, low=True),
)


def _bind(value: Column, use) -> Column:
    """Evaluate `value` once and hand it to `use`."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Windows are compared by their 64-bit hashes, within one text only.
    """

    def covered(hashes):
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s):
            def at(pair, k):
                before = F.get(s, k - 1)["h"] == pair["h"]
                after = F.get(s, k + 1)["h"] == pair["h"]
                return F.when(F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)), pair["i"])

            return F.array_sort(F.filter(F.transform(s, at), lambda i: i.isNotNull()))

        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            _bind(ordered, twice),
            start,
            lambda a, i: F.struct(
                (a["n"] + i + 3 - F.greatest(a["end"], i)).alias("n"), (i + 3).alias("end")
            ),
            lambda a: a["n"],
        )

    def of(w):
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))
        return F.when(F.size(w) < 4, 0).otherwise(_bind(windows, count))

    return of(words)


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    filled = lambda parts: F.filter(parts, lambda x: F.btrim(x, F.lit(_BLANK_CHARS)) != "")

    def of_words(w):
        return F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(
            F.size(lines).alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        )

    words = F.filter(F.split(text, f"[{BLANKS}]+", -1), lambda x: x != "")
    counted = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        _bind(words, of_words).alias("w"),
        _bind(filled(F.split(text, "\n", -1)), of_lines).alias("l"),
        F.length(F.translate(text, _BLANK_CHARS, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).alias("n_symbols"),
    )
    longs = {
        "n_words": F.col("w.n_words"),
        "word_chars": F.col("word_chars"),
        "n_symbols": F.col("n_symbols"),
        "n_dup_lines": F.col("l.n_dup_lines"),
        "n_repeat_words": F.col("w.n_repeat_words"),
        "n_lines": F.col("l.n_lines"),
    }
    counted = counted.select(
        "doc_id", "lang", "source", *[c.cast("long").alias(name) for name, c in longs.items()]
    )
    few = F.col("n_words") < 50
    return counted.withColumn("base_failed", few | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _values() -> dict[str, Column]:
    """The metrics of the rules, in thousandths."""
    share = lambda a, b: F.floor(1000 * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    return {
        "symbols": share("n_symbols", "n_words"),
        "repeats": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "word_length": share("word_chars", "n_words"),
    }


def _bucket(value: Column) -> Column:
    """The value with all but its six leading bits cleared."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, rule, bucket, n: the sketches of all documents that pass the base rules."""
    each = F.array(
        *[F.struct(F.lit(k).alias("rule"), _bucket(v).alias("bucket")) for k, v in _values().items()]
    )
    return (
        counted.where(~F.col("base_failed"))
        .select("lang", "source", F.explode(each).alias("v"))
        .groupBy("lang", "source", "v.rule", "v.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, by: list[str], rules, spreads: int) -> DataFrame:
    """`by`, docs, and the low and high fence of every rule, from merged sketches."""
    merged = sketch.groupBy(*by, "rule", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "rule")
    ranked = merged.withColumns(
        {"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)}
    )
    quantile = lambda p: F.min(F.when(100 * F.col("upto") >= p * F.col("docs"), F.col("bucket")))
    cut = ranked.groupBy(*by, "rule").agg(
        F.max("docs").alias("docs"), *[quantile(p).alias(f"q{p}") for p in (25, 50, 75)]
    )
    least = reduce(lambda c, r: c.when(F.col("rule") == r.name, r.least_spread), rules, F)
    spread = F.greatest(F.col("q75") - F.col("q25"), least)
    columns = []
    for r in rules:
        own = F.col("rule") == r.name
        columns.append(F.max(F.when(own, F.col("q50") + spreads * spread)).alias(f"{r.name}_high"))
        if r.low:
            columns.append(F.max(F.when(own, F.col("q50") - spreads * spread)).alias(f"{r.name}_low"))
    return cut.groupBy(*by).agg(F.max("docs").alias("docs"), *columns)


def thresholds(sketch: DataFrame, rules=RULES, group_docs: int = GROUP_DOCS,
               spreads: int = SPREADS) -> DataFrame:
    """Fences of every (lang, source): its own, its language's, or the whole corpus's."""
    own = _fences(sketch, ["lang", "source"], rules, spreads)
    wider = _fences(sketch, ["lang"], rules, spreads).withColumnRenamed("lang", "_lang")
    whole = _fences(sketch, [], rules, spreads)  # one row
    names = [c for c in own.columns if c not in ("lang", "source", "docs")]
    put = lambda df, mark: df.select(
        *[F.col(c).alias(f"{mark}{c}") if c in [*names, "docs"] else F.col(c) for c in df.columns]
    )
    joined = (
        put(own, "o_")
        .join(put(wider, "l_"), F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .join(F.broadcast(put(whole, "w_")), F.lit(True), "left")
    )
    pick = lambda c: (
        F.when(F.col("o_docs") >= group_docs, F.col(f"o_{c}"))
        .when(F.col("l_docs") >= group_docs, F.col(f"l_{c}"))
        .otherwise(F.col(f"w_{c}"))
        .alias(c)
    )
    return joined.select("lang", "source", *[pick(c) for c in names])


def judge(docs: DataFrame, rules=RULES, group_docs: int = GROUP_DOCS, spreads: int = SPREADS) -> DataFrame:
    """The counts of every document, base_failed, and kept.

    kept is false for documents that fail the base rules or lie beyond a fence of their
    language and source. Null languages and sources are groups of their own; repeated rows
    are judged alike and each counts. An empty table gives an empty one.
    """
    counted = settle(metrics(docs))
    fences = thresholds(sketches(counted), rules, group_docs, spreads).withColumnsRenamed(
        {"lang": "_lang", "source": "_source"}
    )
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for r in rules:
        value = _values()[r.name]
        inside &= value <= F.col(f"{r.name}_high")
        if r.low:
            inside &= value >= F.col(f"{r.name}_low")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return counted.join(fences, same, "left").select(*counted.columns, kept.alias("kept"))
