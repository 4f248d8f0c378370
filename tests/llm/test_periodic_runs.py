from __future__ import annotations

import math
import random
import re
import zlib
from fractions import Fraction
from hashlib import sha256

import pytest

from evalsieve.llm import periodic_runs
from evalsieve.llm.queries import REGISTRY, _with_planted_runs


def plain_runs(t, words=24, periods=3):
    """Every stretch that each period keeps, its smallest period first."""
    found = {}
    for p in range(1, len(t) // periods + 1):
        i = p
        while i < len(t):
            a = i
            while i < len(t) and t[i] == t[i - p]:
                i += 1
            if i > a and i - a + p >= max(words, periods * p):
                found.setdefault((a - p, i), p)
            i += 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


def nested(draw):
    """Words with runs in runs, cut at odd places."""
    out, letters = [], draw.choice(["ab", "abc", "abcdefgh"])
    most = draw.randint(1, 300)
    while len(out) < most:
        root = [draw.choice(letters) for _ in range(draw.choice([1, 1, 2, 3, 4, 5, 7, 9, 13, 20, 30]))]
        if draw.random() < 0.5:
            root = [draw.choice(letters)] * draw.randint(1, 12) + root
        out += root * draw.randint(1, 5)
        out = out[: len(out) - draw.randrange(min(5, len(out)))]
        if draw.random() < 0.3:
            out += out[-draw.randint(1, len(out)) :] * draw.randint(1, 3)
    return out[:400]


@pytest.mark.parametrize("words", [1, 3, 24])
def test_runs_by_trying_every_period(words):
    draw = random.Random(words)
    for _ in range(1500):
        text = nested(draw)
        assert periodic_runs.runs_of(text, words) == plain_runs(text, words), "".join(text)


def test_higher_exponents():
    draw = random.Random(9)
    for _ in range(300):
        text = nested(draw)
        assert periodic_runs.runs_of(text, 5, 4) == plain_runs(text, 5, 4)
    with pytest.raises(ValueError):
        periodic_runs.SquareCatcher(periods=2)


def test_append_in_any_portions():
    draw = random.Random(4)
    for _ in range(200):
        text = nested(draw)
        catcher, at = periodic_runs.SquareCatcher(3), 0
        while at < len(text):
            step = draw.randint(1, 40)
            catcher.append(text[at : at + step])
            at += step
            assert catcher.runs() == plain_runs(text[:at], 3)  # after every portion, not only at the end


def fibonacci(n):
    a, b = "b", "a"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [
    lambda n: "a" * n,
    lambda n: "ab" * (n // 2),
    fibonacci,
    lambda n: ("a" * 1000 + "b") * (n // 1001),
    lambda n: (("a" * 30 + "b") * 30 + "c") * (n // 931),
    lambda n: "".join("a" * k + "b" for k in range(1, int(math.sqrt(2 * n)))),
    lambda n: "".join(random.Random(1).choices("ab", k=n)),
], ids=["one", "two", "fibonacci", "runs", "runs of runs", "growing", "random"])
def test_work_grows_as_n_log_n(make):
    for n in (4_000, 64_000):
        text = make(n)
        catcher = periodic_runs.SquareCatcher()
        catcher.append(text)
        assert catcher.started <= 3 * n
        assert catcher.looked_back <= 2 * n * math.log2(n)
        assert sum(map(len, catcher._waiting.values())) <= 40 * math.log2(n)


def test_strongest_is_exact():
    runs = [(0, 30, 10), (40, 31, 10), (90, 62, 20), (200, 28, 9)]
    assert periodic_runs.strongest(runs) == max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0]))
    assert periodic_runs.strongest([]) is None


def plain_collapse(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_collapse():
    draw = random.Random(6)
    for _ in range(300):
        text = nested(draw)
        runs = plain_runs(text, 3)
        assert periodic_runs.collapse(text, runs) == plain_collapse(text, runs)


def test_odd_tables(spark, odd_docs, no_docs):
    rows = periodic_runs.find_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].runs == [] and by_id[4].strongest is None and by_id[4].collapsed == ""
    assert by_id[5].collapsed == "" and by_id[9].collapsed == "one"
    for r in odd_docs.where("doc_id in (1, 2, 6, 7, 8)").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        if len(words) < 2000:
            assert [tuple(x) for x in by_id[r.doc_id].runs] == plain_runs(words)
    assert periodic_runs.find_runs(no_docs).collect() == []


def test_very_long_text(spark):
    text = "intro " + "la " * 100_000 + "outro " * 30 + " ".join(f"w{i}" for i in range(50_000))
    (row,) = periodic_runs.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 100_000, 1), (100_001, 30, 1)]
    assert row.collapsed.startswith("intro la outro w0 w1 ")


def test_registered_query(spark):
    """Against the rule itself: planted words, runs by every period, digests."""
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in REGISTRY["op12_periodic_runs"](spark, folder).collect()}
    assert rows.keys() == texts.keys()
    some = 0
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(words)
        r = rows[doc_id]
        some += bool(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha256("".join(f"{s},{m},{p}\n" for s, m, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest()
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        got = (r.start, r.length, r.period, r.exponent_milli)
        assert got == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 10


def test_planting_on_odd_tables(odd_docs, no_docs):
    rows = _with_planted_runs(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert _with_planted_runs(no_docs).collect() == []
