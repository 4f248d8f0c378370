"""What tells two readings of a training set apart.

A set has two fingerprints: sums, modulo 2^128, of a 128-bit hash of every row. One is of the
rows alone and does not depend on their order; the other is of each row with its position.
Sums merge in any order, so both come from one pass without a shuffle of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: What a training row is made of, without its position.
ROW_COLUMNS = ("prompt", "answer", "source", "id")

_LANES = 8  # of 16 bits: their sums fit 64 bits up to 2^47 rows


def _encoded(columns: Sequence[str]) -> Column:
    """The values as one text that no other values give."""
    parts = []
    for name in columns:
        value = F.col(name).cast("string")
        parts.append(F.coalesce(F.concat(F.length(value), F.lit(":"), value), F.lit("-")))
    return F.concat_ws(";", *parts)


def _lane_sums(digest: str) -> list[Column]:
    sums = []
    for i in range(_LANES // 2):
        half = F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
        sums += [F.sum(F.shiftright(half, 16)), F.sum(half.bitwiseAND(F.lit(0xFFFF)))]
    return [F.coalesce(s, F.lit(0).cast("long")).alias(f"{digest}{i}") for i, s in enumerate(sums)]


def _total(digest: str) -> Column:
    """The lanes' sums as one number of 128 bits, in hexadecimal digits."""
    digits, carry = [], F.lit(0).cast("long")
    for i in reversed(range(_LANES)):
        lane = F.col(f"{digest}{i}") + carry
        digits.append(F.lpad(F.lower(F.hex(lane.bitwiseAND(F.lit(0xFFFF)))), 4, "0"))
        carry = F.shiftright(lane, 16)
    return F.concat(*reversed(digits))


def fingerprints(
    rows: DataFrame, columns: Sequence[str] = ROW_COLUMNS, position: str = "row_idx"
) -> DataFrame:
    """One row: training_size, content_fingerprint (of the multiset of rows) and
    placed_fingerprint (of the rows at their positions)."""
    content = _encoded(columns)
    placed = F.concat(F.coalesce(F.col(position).cast("string"), F.lit("-")), F.lit(";"), content)
    hashed = rows.select(F.md5(content.cast("binary")).alias("c"), F.md5(placed.cast("binary")).alias("p"))
    sums = hashed.agg(F.count(F.lit(1)).alias("training_size"), *_lane_sums("c"), *_lane_sums("p"))
    return sums.select(
        "training_size",
        _total("c").alias("content_fingerprint"),
        _total("p").alias("placed_fingerprint"),
    )


def refuse_other(seen: Row, now: Row) -> None:
    """Raise unless two readings hold the same rows at the same positions."""
    if now["training_size"] != seen["training_size"]:
        raise ValueError(f"detection saw {seen['training_size']} training rows, the file has {now['training_size']}")
    if now["content_fingerprint"] != seen["content_fingerprint"]:
        raise ValueError("the training rows have been edited since the detection")
    if now["placed_fingerprint"] != seen["placed_fingerprint"]:
        raise ValueError("the training rows have been put in another order since the detection")
