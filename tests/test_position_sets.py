from __future__ import annotations

import random
from itertools import combinations

from evalsieve.operators import position_sets as ps


def case(spark):
    draw = random.Random(8)
    sets = {"a": set(range(0, 400, 3)), "b": {draw.randrange(10**12) for _ in range(200)} | set(range(63, 130)), "c": {0, 63, 64, 2**40}}
    rows = [(name, p) for name, own in sets.items() for p in own] * 2
    draw.shuffle(rows)
    return sets, ps.from_positions(spark.createDataFrame(rows, "benchmark string, at long").repartition(5), "at", "benchmark")


def members(df):
    found = {}
    for r in ps.positions(df).collect():
        found.setdefault(r.set, []).append(r.position)
    assert all(len(v) == len(set(v)) for v in found.values())
    return {name: set(v) for name, v in found.items()}


def test_positions_come_back(spark):
    sets, table = case(spark)
    assert members(table) == sets
    assert {r.set: r["size"] for r in ps.sizes(table).collect()} == {name: len(own) for name, own in sets.items()}
    assert table.where("set = 'a'").count() < 10  # a word for 64 positions


def test_algebra_by_python_sets(spark):
    sets, table = case(spark)
    a, b, c = (sets[n] for n in "abc")
    assert members(ps.union_all(table, "u")) == {"u": a | b | c}
    assert members(ps.union_all(table, "u", ["a", "c"])) == {"u": a | c}
    assert members(ps.intersect_all(table, "i", ["a", "b"])) == {"i": a & b}
    assert members(ps.intersect_all(table, "i", ["a", "b", "c"])).get("i", set()) == a & b & c
    assert members(ps.minus(table, "m", "b", "a")) == {"m": b - a}
    assert members(ps.minus(table, "m", "b", "unknown")) == {"m": b}
    assert members(ps.minus(table, "m", "a", "a")) == {}


def test_sets_merge_across_jobs(spark):
    sets, table = case(spark)
    later = ps.from_positions(spark.createDataFrame([("a", 1), ("d", 5)], "benchmark string, at long"), "at", "benchmark")
    merged = table.unionByName(later).groupBy("set", "word").agg({"bits": "bit_or"}).withColumnRenamed("bit_or(bits)", "bits")
    assert members(merged) == {**sets, "a": sets["a"] | {1}, "d": {5}}


def test_overlap_matrix(spark):
    sets, table = case(spark)
    names = spark.createDataFrame([(n,) for n in ["a", "b", "c", "none"]], "set string")
    sets = {**sets, "none": set()}
    wanted = {
        (x, y, len(sets[x]), len(sets[y]), len(sets[x] & sets[y]), len(sets[x] - sets[y]), len(sets[y] - sets[x]), len(sets[x] | sets[y]))
        for x, y in combinations(sorted(sets), 2)
    }
    assert {tuple(r) for r in ps.overlaps(table, names).collect()} == wanted


def test_nothing_and_nulls(spark):
    nothing = spark.createDataFrame([("a", None)], "benchmark string, at long")
    table = ps.from_positions(nothing, "at", "benchmark")
    assert table.count() == 0 and members(ps.union_all(table, "u")) == {}
    names = spark.createDataFrame([("a",)], "set string")
    assert ps.overlaps(table, names).count() == 0
