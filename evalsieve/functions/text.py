"""Text rules as native column expressions.

Everything here stays inside the JVM. The rules follow Python's string
semantics (whitespace, strip, code points), because the scores and the matches
are defined in those terms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as whitespace.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same set as a pattern. Java's Unicode \s lacks U+001C to U+001F.
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
NO_WHITESPACE = r"(?U)[^\s\x1c-\x1f]+"

# The prompt given to every model, around the question.
PROMPT_HEAD = (
    "You are a math problem solving assistant.\n"
    "Solve the following problem step by step and put the final answer in \\boxed{}.\n"
    "\n"
    "Problem:\n"
)
PROMPT_TAIL = "\n\nSolution:\n"

BOX = "\\boxed{"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Split on whitespace, no empty words, case kept."""
    return F.array_remove(F.split(_col(text), WHITESPACE), "")


def tokenize(text: Column | str) -> Column:
    """Lower-cased words with their punctuation; the default matching tokens."""
    return words(F.lower(_col(text)))


def first_words(text: Column | str, count: Column) -> Column:
    """The first `count` words, without splitting the rest of a long text."""
    # two spare pieces: an empty one before leading whitespace, and the rest
    pieces = F.split(_col(text), WHITESPACE, (count + 2).cast("int"))
    return F.slice(F.array_remove(pieces, ""), F.lit(1), count.cast("int"))


def cut_after(text: Column | str, count: int) -> Column:
    """A text up to the end of its `count`-th word, with its own whitespace."""
    # pieces around the words: before the first, between, and after the last
    gaps = F.slice(F.split(_col(text), NO_WHITESPACE, -1), 1, count)
    kept = F.zip_with(gaps, F.slice(words(text), 1, count), lambda gap, word: F.concat(gap, word))
    return F.array_join(kept, "")


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(WHITESPACE_CHARS))


def prefix(text: Column | str, ratio: Column | float) -> Column:
    """The leading share of a text by characters, at least one character."""
    text = _col(text)
    ratio = (ratio if isinstance(ratio, Column) else F.lit(float(ratio))).cast("double")
    shown = F.greatest(F.lit(1), F.floor(F.length(text) * ratio).cast("int"))
    return F.when(ratio >= 1.0, text).otherwise(F.substring(text, F.lit(1), shown))


def tail(text: Column | str, shown: Column | str) -> Column:
    """What follows a shown prefix."""
    text, shown = _col(text), _col(shown)
    return F.substring(text, F.length(shown) + 1, F.length(text))


def boxed(text: Column | str) -> Column:
    r"""Body of the last \boxed{...}, nested braces included, stripped.

    Empty when there is no box, or when the last one is never closed.
    """
    text = _col(text)
    # every piece but the last one is followed by a closing brace
    pieces = F.split(F.substring_index(text, BOX, -1), r"\}")
    start = F.struct(
        F.lit(1).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("closed_at")
    )

    def step(state: Column, piece: Column) -> Column:
        opened = F.length(piece) - F.length(F.replace(piece, F.lit("{"), F.lit("")))
        depth = state["depth"] + opened - 1
        seen = state["seen"] + 1
        closes = (state["closed_at"] == 0) & (depth == 0)
        return F.struct(
            depth.alias("depth"),
            seen.alias("seen"),
            F.when(closes, seen).otherwise(state["closed_at"]).alias("closed_at"),
        )

    closed_at = F.aggregate(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step, lambda s: s["closed_at"]
    )
    body = F.array_join(F.slice(pieces, F.lit(1), closed_at), "}")
    return F.when(F.contains(text, F.lit(BOX)) & (closed_at > 0), strip(body)).otherwise(F.lit(""))


def normalize_answer(answer: Column | str) -> Column:
    """Comparable form of an answer: no $, no outer box, no final dots, single spaces."""
    bare = strip(F.replace(strip(answer), F.lit("$"), F.lit("")))
    # (?d) makes the dot exclude \n only, as in Python
    whole_box = r"(?d)\A\\boxed\{(.*)\}\z"
    inner = strip(F.regexp_extract(bare, whole_box, 1))
    unboxed = F.when(F.regexp_like(bare, F.lit(whole_box)), inner).otherwise(bare)
    return F.array_join(words(F.rtrim(unboxed, F.lit("."))), " ")


def build_prompt(question: Column | str) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), _col(question), F.lit(PROMPT_TAIL))


def short_model_name(model_id: Column | str) -> Column:
    """Last path part of a model id, with a file-safe colon."""
    path = F.regexp_replace(_col(model_id), r"/\z", "")
    return F.replace(F.substring_index(path, "/", -1), F.lit(":"), F.lit("_"))


def match_set_name(name: Column | str) -> Column:
    return F.translate(F.lower(_col(name)), "-.", "__")


def file_stem(file_name: Column | str) -> Column:
    """File name without its folder and its last extension."""
    return F.regexp_replace(F.substring_index(_col(file_name), "/", -1), r"(?<=.)\.[^.]*\z", "")
