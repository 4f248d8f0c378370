from __future__ import annotations

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()

#: Columns that tables may have besides, named like those that the operators make.
EXTRA = "key string, score double, start int, fp string, removed string, dropped int, kept string, spans int, length int"


def prose(n: int, seed: int = 0) -> str:
    return " ".join(WORDS[(i * i * 7 + i * (seed + 3) + seed) % len(WORDS)] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, extra columns."""
    long_text = "\n".join(prose(40, i) + "." for i in range(1500))
    rows = [
        (1, prose(80), "en", "a"),
        (2, prose(80), "en", "a"),
        (2, prose(80), "en", "a"),
        (3, "", "en", None),
        (4, None, None, "a"),
        (None, prose(60, 5), "en", "b"),
        (None, prose(60, 5), "en", "b"),
        (None, None, None, None),
        (5, " \n\t \n", "de", "b"),
        (6, long_text, "de", "b"),
        (7, "x" * 200_000, "de", "c"),
        (8, "Ünïcödé \U0001f600 ﬁ \u0000 <|endoftext|> 'S it's\r\nz", "fr", "c"),
        (9, "one", "fr", "c"),
    ]
    extra = ("k", 0.5, 3, "f", "r", 1, "t", 2, 4)
    return spark.createDataFrame(
        [(*r, None if r[1] is None else len(r[1]), *extra) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA,
    )


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
