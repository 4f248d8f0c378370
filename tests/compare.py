"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted(
        (tuple(row[i] for i in order) for row in rows), key=_key
    )


def difference(df, con, sql: str) -> str | None:
    """None when both give the same columns and rows."""
    names, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want_names, want = rows_of([d[0] for d in found.description], found.fetchall())
    if names != want_names:
        return f"columns {names} != {want_names}"
    if len(ours) != len(want):
        return f"{len(ours)} rows != {len(want)}"
    for a, b in zip(ours, want):
        for name, x, y in zip(names, a, b):
            if isinstance(x, float) and isinstance(y, float):
                same = x == y or (math.isnan(x) and math.isnan(y))
            else:
                same = x == y and type(x) is type(y)
            if not same:
                return f"{name}: {x!r} != {y!r}"
    return None
