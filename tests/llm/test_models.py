from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from evalsieve.llm import quality_classifier as qc
from evalsieve.llm import topk

from .conftest import prose


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        text = prose(40 + i % 30, i)
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        if i % 5:
            labels.append((i, int(good)))
    labels += [(1, None), (2, 7), (9999, 1)]
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int"), rows)


def test_held_out_accuracy(labelled):
    docs, labels, rows = labelled
    found = {r.doc_id: r for r in qc.classify(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    held = [i for i, r in found.items() if r.held_out]
    assert np.mean([found[i].predicted == (i % 4 != 0) for i in held]) > 0.97
    kept = qc.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if r.predicted}


def test_held_out_labels_do_not_count(spark, labelled):
    docs, labels, _ = labelled
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality")
    a = {r.doc_id: r.score for r in qc.classify(docs, labels).collect()}
    assert a == {r.doc_id: r.score for r in qc.classify(docs.repartition(7), turned).collect()}


def test_log_ratios_by_counting(labelled):
    docs, labels, rows = labelled
    train = {r.doc_id: r.quality for r in qc.training_labels(labels).collect()}
    seen = np.zeros((2, 1 << qc.BITS))
    size = [0, 0]
    for i, text in rows:
        if i in train:
            seen[train[i], qc.features(text)] += 1
            size[train[i]] += 1
    want = np.log((seen[1] + 1) / (size[1] + 2)) - np.log((seen[0] + 1) / (size[0] + 2))
    some = seen.any(axis=0)
    got = qc.log_ratios(docs, qc.training_labels(labels))
    assert np.allclose(got[some], want[some]) and not got[~some].any()


def test_descent_reaches_the_optimum():
    """The dual's gap closes: hinge loss plus norm equals the dual value."""
    draw = np.random.default_rng(3)
    rows = [np.unique(draw.integers(0, 50, 8)) for _ in range(120)]
    labels = np.array([int(r.sum() % 3 == 0) for r in rows])
    ratios = np.zeros(1 << qc.BITS)
    ratios[:50] = draw.normal(size=50)
    weights, bias = qc.descend(rows, labels, ratios, epochs=400)
    x = np.zeros((120, 51))
    for k, r in enumerate(rows):
        v = ratios[r] / np.linalg.norm(ratios[r])
        x[k, r], x[k, 50] = v, 1
    w = np.r_[weights[:50], bias]
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - np.where(labels, 1, -1) * (x @ w)).sum()
    assert all(loss(w) <= loss(w + draw.normal(size=51) * s) + 1e-3 for s in (0.3, 0.1, 0.03, 0.01) for _ in range(50))


def test_features_are_distinct():
    for text in ("", " ", "a", "ab", "a b", prose(50), "a a a a a a", "é" * 10, "x" * 100_000):
        own = qc.features(text)
        assert len(own) == len(set(own.tolist())) and (text != "") >= (len(own) > 0)


def test_classifier_on_odd_tables(spark, odd_docs, no_docs, labelled):
    _, labels, _ = labelled
    assert qc.classify(odd_docs, labels).count() == odd_docs.count()
    assert qc.classify(no_docs, labels).count() == 0
    none = spark.createDataFrame([(None, None)], "doc_id long, quality int")
    assert {r.score for r in qc.classify(odd_docs, none).collect()} == {0.5}
    assert qc.keep_good(odd_docs, none).count() == odd_docs.count()


def plain_top(vectors, queries, k):
    out = set()
    for q, x in queries:
        width = max([len(x), *(len(v) for _, v in vectors)])
        pad = lambda v: np.pad(np.array(v, dtype=object), (0, width - len(v)))
        scores = sorted((-(pad(x) * pad(v)).sum(), i) for i, v in vectors if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block,rows,chunk", [(4, 16, 3), (512, 8192, 512)])
def test_top_k_by_brute_force(spark, monkeypatch, block, rows, chunk):
    random.seed(2)
    vectors = [(i, [random.randint(-5, 5) for _ in range(6)]) for i in range(150)]
    vectors += [(1000 + i, [3] * 6) for i in range(60)] + [(0, [5] * 6), (7000, [2, 2]), (7001, [2**40] * 6)]
    monkeypatch.setattr(topk, "RANGE", rows)
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk.search, "__defaults__", (topk.K, block))
    df = spark.createDataFrame(vectors, "vec_id long, x array<long>").repartition(3)
    queries = [v for v in vectors if v[0] % 20 == 0]
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7).collect()
    same = [r for r in got if r.query_id != 0]
    assert {tuple(r) for r in same} == plain_top(vectors, [q for q in queries if q[0] != 0], 7)
    assert len(got) == 7 * len(queries)


def test_whole_vectors(spark):
    rows = [(1, [0.5, -0.01], 1), (2, None, 1), (3, [None, 1.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf")], 1),
            (6, [], 1), (None, [1.0], 1), (7, [1.0], 1), (7, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x int")
    assert sorted(map(tuple, topk.whole_vectors(df).collect())) == [(1, [32, -1]), (7, [64]), (7, [64])]
    whole = topk.whole_vectors(df)
    assert topk.top_k(whole, whole.limit(0)).count() == 0 and topk.top_k(whole.limit(0), whole).count() == 0
    assert {tuple(r) for r in topk.top_k(whole, whole.where("vec_id = 1")).collect()} == {(1, 1, 7, 2048), (1, 2, 7, 2048)}
