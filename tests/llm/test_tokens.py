from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evalsieve.llm import bpe, packing
from evalsieve.scale import settle

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def own_ids(text):
    vocab = bpe.vocabulary(PATH)
    words = vocab.words(text)
    plain = [w for w in words if w not in vocab.special]
    ids = dict(zip(plain, vocab.encode_words(plain)))
    return [int(i) for w in words for i in (ids[w] if w in ids else [vocab.special[w]])]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert own_ids(text) == Tokenizer_.encode(text, add_special_tokens=False).ids


Tokenizer_ = Tokenizer.from_file(PATH)


def test_every_character_and_runs(library):
    texts = [f"a{chr(c)} {chr(c)}{chr(c)} 1{chr(c)}'{chr(c)}" for c in range(0x2100) if not 0xD800 <= c < 0xE000]
    texts += ["a" * n for n in range(40)] + ["aab" * n for n in range(20)] + ["ΟΔΟΣ İstanbul", "<|endoftext|>", "a<|startoftext|>b<|"]
    for text, code in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own_ids(text) == code.ids, text


def test_encode_and_decode(spark, odd_docs, no_docs, library):
    found = bpe.encode_and_decode(odd_docs, PATH).collect()
    assert len(found) == odd_docs.count()
    texts = defaultdict(list)
    for r in odd_docs.collect():
        texts[r.doc_id].append(r.text or "")
    for r in found:
        codes = [library.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]
        assert r.ids in [" ".join(map(str, c)) for c in codes]
        assert r.decoded in [library.decode(c, skip_special_tokens=False) for c in codes]
    assert bpe.encode_and_decode(no_docs, PATH).count() == 0


def test_worker_memory_starts_afresh():
    memory = bpe.WordMemory(lambda words: [w.upper() for w in words], most=3)
    memory.update({"a", "b"})
    memory.update({"b", "c", "d"})
    assert {w: memory.known[w] for w in "bcd"} == {"b": "B", "c": "C", "d": "D"}


def test_pieces(odd_docs, no_docs, library):
    made = packing.token_pieces(odd_docs, PATH, length=64).collect()
    by_doc = defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append(r)
        assert r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    for r in odd_docs.where("doc_id not in (2)").collect():
        if r.doc_id is not None:
            pieces = sorted(by_doc[r.doc_id], key=lambda p: p.piece)
            ids = [i for p in pieces for i in p.ids]
            assert ids == [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
            assert [p.start for p in pieces] == [64 * i for i in range(len(pieces))]
    assert packing.token_pieces(no_docs, PATH).count() == 0
    assert packing.pack(packing.token_pieces(no_docs, PATH)).count() == 0


def check_packed(rows, length):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(by_sequence)


def test_pack_is_whole_gapless_and_tight(spark):
    random.seed(4)
    sizes = [random.choice([1, 3, 17, 60, 100, 64, 33]) for _ in range(3000)]
    df = spark.createDataFrame([(None if i % 7 == 0 else 2**60 + i, s, 9) for i, s in enumerate(sizes)],
                               "doc_id long, length long, sequence_id int")
    rows = packing.pack(df, length=100, open_sequences=50, task_pieces=100).collect()
    assert sorted(r.length for r in rows) == sorted(sizes)
    assert sorted(r.doc_id or 0 for r in rows) == sorted(0 if i % 7 == 0 else 2**60 + i for i in range(3000))
    # no packing is better than its pieces allow; pieces above half a sequence meet none alike
    least = max(-(-sum(sizes) // 100), sum(s > 50 for s in sizes))
    assert check_packed(rows, 100) <= 1.05 * least
    again = packing.pack(df.repartition(5), length=100, open_sequences=50, task_pieces=100).collect()
    assert {(r.doc_id, r.sequence_id, r.offset) for r in again} == {(r.doc_id, r.sequence_id, r.offset) for r in rows}


def test_open_sequences_by_a_plain_list():
    random.seed(2)
    for most in (1, 3, 8):
        bins, plain, made = packing.OpenSequences(50, most), [], 0
        for size in (random.randint(1, 50) for _ in range(500)):
            own, offset = bins.place(size)
            fitting = [b for b in plain if b[1] >= size]
            if fitting:  # the tightest
                assert 50 - offset == min(b[1] for b in fitting)
            else:
                assert own == made
                made += 1
                if len(plain) >= most:
                    fullest = min(b[1] for b in plain)
                    closed = bins.closed[-2] if 50 == size else bins.closed[-1]
                    assert (closed, fullest) in plain
                    plain.remove((closed, fullest))
            plain = [b for b in plain if b[0] != own]
            if 50 - offset - size:
                plain.append((own, 50 - offset - size))
            assert len(plain) <= most


def test_sequences_hold_the_ids(odd_docs):
    packed = settle(packing.pack(settle(packing.token_pieces(odd_docs, PATH, length=4096))))
    whole = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in packed.collect())
