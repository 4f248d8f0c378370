"""ROUGE-L between a hidden text and a completion.

Only the length of the longest common subsequence needs Python; it runs as an
Arrow batch function next to the data. Token counts and the score are native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9, separated by one space."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def token_count(tokens: Column) -> Column:
    return F.when(tokens == "", F.lit(0)).otherwise(F.size(F.split(tokens, " ")))


def lcs_length(left: Column, right: Column) -> Column:
    """Length of the longest common subsequence of two space-separated texts."""

    # Local functions, so that workers receive them by value.
    def common(a: str | None, b: str | None) -> int:
        if not a or not b:
            return 0
        where: dict[str, int] = {}
        size = 0
        for token in a.split():
            where[token] = where.get(token, 0) | (1 << size)
            size += 1
        full = (1 << size) - 1
        open_bits = full  # a cleared bit marks one matched step
        for token in b.split():
            here = where.get(token)
            if here is not None:
                hit = open_bits & here
                open_bits = ((open_bits + hit) | (open_bits - hit)) & full
        return size - open_bits.bit_count()

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([common(x, y) for x, y in zip(a, b)], dtype="int64")

    return F.pandas_udf(batch, "long")(left, right)


def f_measure(lcs: Column, target_tokens: Column, guess_tokens: Column) -> Column:
    """F1 of precision and recall; 0 when nothing is shared or a side is empty."""
    precision = F.try_divide(lcs.cast("double"), guess_tokens.cast("double"))
    recall = F.try_divide(lcs.cast("double"), target_tokens.cast("double"))
    return F.when(lcs > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
