from __future__ import annotations

from hashlib import sha256

import duckdb
import numpy as np
import pytest

from evalsieve.llm import vector_codes, vector_codes_sql
from evalsieve.llm.queries import REGISTRY


def plain_nearest(entries, points):
    """All distances in whole numbers of any size."""
    found = []
    for p in points.tolist():
        found.append(min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(entries.tolist())))
    return [i for _, i in found], [d for d, _ in found]


@pytest.mark.parametrize("size", [1, 2, 5, 13, 60, 256])
@pytest.mark.parametrize("spread", [2, 40, 3000, 1 << 26])
def test_tree_finds_the_first_nearest(size, spread):
    draw = np.random.default_rng(size * 7 + spread % 11)
    for splits, leaf in ((2, 1), (4, 3), (12, 12)):
        entries = draw.integers(-spread, spread + 1, (size, 3))
        entries[size // 2 :] = entries[: size - size // 2]  # copies: the first of them counts
        points = np.r_[draw.integers(-spread, spread + 1, (60, 3)), entries]
        index, squares = vector_codes.Tree(entries, splits, leaf).nearest(points)
        assert (index.tolist(), squares.tolist()) == plain_nearest(entries, points)


def test_ties_between_subtrees():
    """Points halfway between entries: a bound that is met exactly does not exclude."""
    line = np.array([[2 * i, 0] for i in range(200)])
    points = np.array([[2 * i + 1, 0] for i in range(199)])
    for order in (np.arange(200), np.arange(200)[::-1], np.random.default_rng(1).permutation(200)):
        tree = vector_codes.Tree(line[order], 3, 2)
        assert (tree.nearest(points)[0].tolist(), tree.nearest(points)[1].tolist()) == plain_nearest(line[order], points)


def test_subtrees_are_left_out():
    draw = np.random.default_rng(2)
    centres = draw.integers(-50_000, 50_000, (16, 16))
    entries = (centres[:, None, :] + draw.integers(-50, 51, (16, 16, 16))).reshape(-1, 16)
    points = centres[draw.integers(0, 16, 2000)] + draw.integers(-50, 51, (2000, 16))
    tree = vector_codes.Tree(entries)
    index, squares = tree.nearest(points)
    every = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (squares == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    assert tree.looked_at < 0.25 * every.size


def test_all_entries_alike_or_none_wide():
    tree = vector_codes.Tree(np.ones((40, 2), dtype=int), 3, 2)
    assert tree.nearest(np.array([[1, 1], [5, 5]]))[0].tolist() == [0, 0]
    assert vector_codes.Tree(np.zeros((3, 0), dtype=int)).nearest(np.zeros((2, 0), dtype=int))[0].tolist() == [0, 0]


def plain_codes(rows, entries=256, rounds=4):
    rows = sorted(rows, key=lambda r: r[0])
    x = np.array([[int(np.floor(1024 * float(v))) for v in r[1]] for r in rows])
    parts = np.split(x, 4, axis=1)
    books = [p[:entries].copy() for p in parts]
    for turn in range(rounds + 1):
        codes, total = [], np.zeros(len(x), dtype=int)
        for p, (part, book) in enumerate(zip(parts, books)):
            squares = ((part[:, None, :] - book[None]) ** 2).sum(axis=2)
            codes.append(squares.argmin(axis=1))
            total = total + squares.min(axis=1)
            if turn < rounds:
                for e in range(len(book)):
                    mine = part[codes[p] == e]
                    if len(mine):
                        book[e] = mine.sum(axis=0) // len(mine)
    by_label = {}
    for r, t in zip(rows, total.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + t
    books_text = ",".join(str(v) for b in books for v in b.reshape(-1).tolist())
    return {
        (r[0], tuple(int(c[i]) for c in codes), int(total[i]), by_label[r[2]]) for i, r in enumerate(rows)
    }, books_text


@pytest.mark.parametrize("entries", [4, 30, 256])
def test_codes_by_plain_numpy(spark, entries):
    draw = np.random.default_rng(entries)
    rows = [(int(i), [float(v) for v in draw.normal(size=8).astype(np.float32)], None if i % 5 == 0 else int(i % 3))
            for i in draw.permutation(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    coded, books = vector_codes.compress(df, entries=entries)
    wanted, text = plain_codes(rows, entries)
    assert {(r.vec_id, tuple(r.codes), r.error, r.label_error) for r in coded.collect()} == wanted
    assert vector_codes.text_of(books) == text


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.5, -0.01, 1.0, 2.0], 1, "c"), (2, None, 1, "c"), (3, [None, 1.0, 1.0, 1.0], 1, "c"),
        (4, [nan, 1.0, 1.0, 1.0], 1, "c"), (5, [inf, 1.0, 1.0, 1.0], 1, "c"), (6, [], 1, "c"),
        (7, [1.0, 2.0, 3.0], 1, "c"), (None, [0.0, 0.0, 0.0, 0.0], None, "c"), (9, [1e30, -1e30, 0.0, 0.0], None, "c"),
        (1, [0.5, -0.01, 1.0, 2.0], 1, "c"),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, codes string")
    coded, books = vector_codes.compress(df)
    got = sorted(coded.collect(), key=lambda r: (r.vec_id is None, r.vec_id or 0))
    assert [r.vec_id for r in got] == [1, 1, 9, None]
    assert len(books) == 4 and books[0].shape == (4, 1)
    assert [r.error for r in got] == [0, 0, 0, 0]
    assert vector_codes.whole_vectors(df).where("vec_id = 9").first().x[:2] == [1 << 26, -(1 << 26)]
    coded, books = vector_codes.compress(df.limit(0))
    assert coded.collect() == [] and books == []
    assert vector_codes.compress(df.drop("label"))[0].select("label_error").distinct().count() == 1


def test_registered_query_and_sql(spark):
    folder = "/root/testdata/sf0.001"
    rows = REGISTRY["op11_vector_codes"](spark, folder).collect()
    own = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    wanted, text = plain_codes(own)
    assert {(r.vec_id, tuple(bytes.fromhex(r.code)), r.error, r.label_error) for r in rows} == wanted
    assert {r.codebooks_sha256 for r in rows} == {sha256(text.encode()).hexdigest()}
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    by_sql = connection.execute(vector_codes_sql.SQL).fetchall()
    assert sorted(by_sql) == sorted(tuple(r) for r in rows)
