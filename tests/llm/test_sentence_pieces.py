from __future__ import annotations

import random
from collections import defaultdict

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from evalsieve.llm import sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.pieces(PATH)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    model = sentence_pieces.pieces(PATH)
    ids = LIBRARY.encode(text)
    assert model.encode(text) == ids
    assert model.decode(ids) == LIBRARY.decode(ids)


def test_runs_and_joined_pieces(model):
    draw = random.Random(3)
    names = [p for p in model.ids if not p.startswith("<")]
    texts = [c * n for c in (" ", "▁", "a", "\n", "\t", "#", "=") for n in range(70)]
    texts += ["".join(draw.choices(names, k=draw.randint(1, 9))) for _ in range(5000)]
    texts += [" ".join(["", "x", ""] * n) for n in range(9)] + ["a͸b", "͸", "\x00", "é​　"]
    for text in texts:
        ids = LIBRARY.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == LIBRARY.decode(ids), text


def test_ids_that_no_text_has(model):
    draw = random.Random(5)
    for _ in range(3000):
        ids = [draw.randrange(3, 260 if draw.random() < 0.6 else 32_000) for _ in range(draw.randint(0, 9))]
        assert model.decode(ids) == LIBRARY.decode(ids), ids


def merged(model, text):
    """The merges one after the other, by the rule itself."""
    parts = list(text)
    while True:
        best = min(((model.turn[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.turn), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


def test_compatible_pairs_by_merging(model):
    draw = random.Random(7)
    names = [p for p in model.ids if p.isascii()] + ["▁" * n for n in (1, 2, 3, 4, 8)]
    for _ in range(20_000):
        a, b = draw.choices(names, k=2)
        assert model.compatible(a, b) == (merged(model, a + b) == [a, b]), (a, b)


def test_long_words_are_linear(model):
    word = "xyzzy" * 100_000
    ids = model.encode(word)
    assert model.decode(ids) == word and ids == LIBRARY.encode(word)


def test_documents(spark, odd_docs, no_docs):
    found = sentence_pieces.encode_and_decode(odd_docs, PATH).collect()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text or "")
    assert len(found) == sum(map(len, texts.values()))
    for r in found:
        codes = [LIBRARY.encode(t) for t in texts[r.doc_id]]
        assert (r.n_tokens, r.ids, r.decoded) in [(len(c), ",".join(map(str, c)), LIBRARY.decode(c)) for c in codes]
    assert sentence_pieces.encode_and_decode(no_docs, PATH).collect() == []


def test_other_models_are_refused(tmp_path):
    other = tmp_path / "other.model"
    other.write_bytes(b"\n\x0e\n\x05<unk>\x15\x00\x00\x00\x00\x18\x02")
    with pytest.raises((ValueError, RuntimeError)):
        sentence_pieces.Pieces(str(other))


def test_registered_query(spark):
    from hashlib import sha256

    from evalsieve.llm.queries import REGISTRY

    folder = "/root/testdata/sf0.001"
    rows = REGISTRY["op13_sentence_pieces"](spark, folder).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(LIBRARY.decode(ids).encode()).hexdigest()
