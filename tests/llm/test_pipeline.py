"""The pipeline over the smallest tables, each stage against a plain version."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from evalsieve.llm import line_templates, quality_classifier, secrets, simhash
from evalsieve.llm.common import keyed
from evalsieve.scale import settle

from .test_duplicates import plain_fingerprint, roots
from .test_tokens import check_packed

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows that each stage got and gave."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = settle(stage(spark, docs, SF_DIR))
        out.append((docs, made))
        docs = made
    return out


def test_is_registered(spark, stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    rows = contract.queries()["pipeline"](spark, SF_DIR)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Every stage but the last gives the columns it got and loses no row but by its decision."""
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "key", "score", "dropped", "removed", "spans")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = settle(stage(spark, docs, SF_DIR))
        assert made.dtypes == docs.dtypes, name
        if name in ("line_dedup", "secret_scan"):
            assert made.count() == docs.count()
            assert made.where("doc_id = 4").first().text is None
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.dtypes == docs.dtypes and empty.count() == 0
    (_, pack) = corpus_pipeline.STAGES[-1]
    packed = pack(spark, docs, SF_DIR)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert pack(spark, docs.limit(0), SF_DIR).count() == 0


def test_columns_stay(stages):
    for got, made in stages[:-1]:
        assert made.dtypes == got.dtypes and 0 < made.count() <= got.count()


def test_quality_stage(spark, stages):
    got, made = stages[0]
    judged = quality_classifier.classify(got, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    want = {r.doc_id for r in judged.collect() if r.predicted}
    assert {r.doc_id for r in made.collect()} == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(labels.get(i, 1) for i in want)


def plain_recurring(texts: dict, group: dict, leading=3, agreeing=0.6, least=2):
    """Numbers of the lines to drop from each text, by dictionaries in one process; `group` is
    the group of near-duplicates of each text."""
    rows, distinct = [], defaultdict(set)
    for key, text in texts.items():
        for number, line in enumerate((text or "").split("\n")):
            tokens = tuple("<*>" if any(c in "0123456789" for c in t) else t for t in line.split())
            if len(tokens) >= leading:
                rows.append((key, number, tokens))
                distinct[len(tokens), tokens[:leading]].add(tokens)

    def edges(own):
        """Of each line the tokens after the leading ones, counted over all, and the count and
        place at which the share is reached."""
        count = Counter((at, t[at]) for t in own for at in range(leading, len(t)))
        for t in own:
            ranked = sorted((-count[at, t[at]], at) for at in range(leading, len(t)))
            if ranked:
                reach = ranked[math.ceil(agreeing * len(ranked)) - 1][0]
                yield t, -reach, min(at for n, at in ranked if n == reach), count

    template = {}
    for own in distinct.values():
        formats = defaultdict(set)
        for t, n, at, _ in edges(own):
            if n > 1:
                formats[at, t[at]].add(t)
        for mine in formats.values():
            for t, n, _, count in edges(mine):
                if n > 1:
                    template[t] = (len(t), t[:leading]) + tuple(
                        (at, t[at]) for at in range(leading, len(t)) if count[at, t[at]] >= n)
    held, gone = defaultdict(set), defaultdict(set)
    for key, _, tokens in rows:
        held[template.get(tokens, tokens)].add(group[texts[key]])
    for key, number, tokens in rows:
        if len(held[template.get(tokens, tokens)]) >= least:
            gone[key].add(number)
    return gone


def grouped(docs):
    """Groups of near-duplicate texts, all of them asked for."""
    rows = keyed(docs).join(simhash.groups_of_texts(docs), "_llm_text").select("text", "group").collect()
    return {r.text: r.group for r in rows}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_by_plain_python(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_recurring(texts, grouped(docs))
    assert sum(map(len, want.values())) > 20
    for r in line_templates.drop_recurring(docs).collect():
        assert {d.line for d in r.dropped} == want[r.doc_id]


def test_leaves_of_any_size_alike(spark):
    """Templates part the lines alike, whether leaves are counted whole, by joins, or mixed."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = settle(line_templates.lines(docs))
    parts = []
    for whole in (10**9, 2_000, -1):
        classes = defaultdict(set)
        for r in line_templates.templates(docs, found, whole=whole).collect():
            classes[r.template].add((r.leaf, r.own))
        parts.append({frozenset(c) for c in classes.values()})
    assert len(parts[0]) > 50 and parts[0] == parts[1] == parts[2]


def test_line_stage(stages):
    got, made = stages[1]
    texts = {r.doc_id: r.text for r in got.collect()}
    gone = plain_recurring(texts, grouped(got))
    for r in made.collect():
        left = "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in gone[r.doc_id])
        assert r.text == left and r.n_chars == len(r.text)


def test_near_duplicate_stage(stages):
    """Three-word shingles and two bits, as `op7_simhash` has them."""
    got, made = stages[2]
    texts = {r.doc_id: r.text for r in got.collect()}
    fps = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    pairs = [(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 2]
    want = roots(fps, pairs)
    assert {r.doc_id for r in made.collect()} == set(want.values())
    assert made.count() == len(set(want.values())) < len(texts)


def test_secret_stage(stages):
    got, made = stages[3]
    spans = {r.doc_id: r.spans for r in secrets.find_secrets(got).collect()}
    texts = {r.doc_id: r.text for r in got.collect()}
    for r in made.collect():
        hidden = {k for s in spans[r.doc_id] for k in range(s.start, s.end)}
        left = "".join(c for k, c in enumerate(texts[r.doc_id]) if k not in hidden)
        assert r.text.replace("<secret>", "") == left and r.n_chars == len(r.text)
    assert made.count() == got.count()


def test_packing_stage(stages):
    got, made = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in made.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == {r.doc_id for r in got.collect()}
    for r in got.collect():
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], dtype="<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.piece)
        assert [p.start for p in own] == list(range(0, len(ids), 4096))
        assert [p.ids_crc32 for p in own] == [zlib.crc32(ids[a : a + 4096].tobytes()) for a in range(0, len(ids), 4096)]
    rows = made.collect()
    assert check_packed(rows, 4096) <= -(-sum(r.length for r in rows) // 4096) + 1
