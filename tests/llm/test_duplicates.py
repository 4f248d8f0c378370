from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as contract
from evalsieve.llm import line_templates, repeated_units, simhash
from evalsieve.llm.components import components

from .conftest import WORDS, prose


def roots(nodes, pairs):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    random.seed(1)
    pairs = {
        "chain": [(i, i + 1) for i in range(60)] + [(100, 90), (90, 100), (7, 7)],
        "star": [(500, i) for i in range(80)],
        "random": [(random.randrange(-50, 100), random.randrange(-50, 100)) for _ in range(70)],
        "none": [],
    }[shape]
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert len(found) == len(nodes)
    assert {r.node: r.root for r in found} == roots(nodes, [(a, b) for a, b in pairs if a != b])


@pytest.mark.parametrize("radius,width", [(0, 1), (2, 1), (3, 1), (7, 2), (43, 4)])
def test_close_pairs_by_counting_bits(radius, width):
    draw = np.random.default_rng(radius)
    buckets = []
    for m in (1, 2, 64, 65, 200):
        base = draw.integers(0, 2**63, (max(1, m // 5), width), dtype=np.uint64)
        fps = base[draw.integers(0, len(base), m)].copy()
        for k in range(m):
            for _ in range(draw.integers(0, radius * 2 + 2)):
                fps[k, draw.integers(width)] ^= np.uint64(1) << np.uint64(draw.integers(64))
        buckets.append(fps)
    for fps, (i, j) in zip(buckets, simhash.close_pairs(buckets, radius)):
        bits = np.unpackbits((fps[:, None] ^ fps[None]).view(np.uint8).reshape(len(fps), len(fps), -1), axis=2).sum(2)
        want = {(a, b) for a, b in zip(*np.nonzero(bits <= radius)) if a < b}
        assert set(zip(i.tolist(), j.tolist())) == want


def plain_fingerprint(text, words):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not own:
        return 0
    grams = [" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_texts():
    """Texts in groups that differ by a word, so that some fingerprints lie close together."""
    random.seed(8)
    texts = ["", None, " \n", "one", "One two", "one two three", "ONE TWO THREE"]
    for seed in range(30):
        base = prose(300, seed).split()
        for _ in range(6):
            own = list(base)
            own[random.randrange(300)] = random.choice(WORDS)
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("bucket", [2, 1024])
def test_small_radius_links_all(spark, bucket, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr(simhash.links, "__defaults__", (bucket,))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    found = {r.doc_id: r for r in simhash.groups(df, words=3, radius=2).collect()}
    fps = [plain_fingerprint(t, 3) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    want = roots(range(len(texts)), pairs)
    assert {i: r.fp[0] % 2**64 for i, r in found.items()} == dict(enumerate(fps))
    assert {i: r.component_id for i, r in found.items()} == want
    assert len(set(want.values())) < len(texts) - 20


def test_similarity_finds_near_copies(spark):
    random.seed(3)
    rows, near = [], {}
    for i in range(60):
        base = [random.choice(WORDS) + str(random.randrange(40)) for _ in range(200)]
        other = list(base)
        other[random.randrange(200)] = "changed"
        other[random.randrange(200)] = "other"
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(other)), (3 * i + 2, " ".join(base))]
        near[3 * i] = {3 * i, 3 * i + 1, 3 * i + 2}
    left = {r.doc_id for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left >= set(near) and len(left) <= 1.03 * len(near)


def test_one_of_each_goes_by_rows(spark):
    a, b, c = prose(60).replace("a", "o"), prose(60), "no one else says this"
    rows = [(3, b, "x"), (7, b, "x"), (7, a, "x"), (9, c, "x"), (9, c, "x"), (None, "only nulls here", "x"), (None, "only nulls here", "x")]
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, more string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted({rows[0], rows[2], rows[3], rows[5]}, key=str)


def test_groups_on_odd_tables(odd_docs, no_docs):
    for how in ({}, {"words": 3, "radius": 2}):
        rows = simhash.groups(odd_docs, **how).collect()
        assert len(rows) == odd_docs.count()
        by_id = {r.doc_id: r.component_id for r in rows}
        assert by_id[1] == by_id[2] == 1
        assert by_id[3] == by_id[4] == by_id[5] == 3  # without words: fingerprint zero
        assert simhash.groups(no_docs, **how).count() == 0
    assert simhash.one_of_each(odd_docs).columns == odd_docs.columns


def plain_units(rows, words):
    """Spans to remove of each (doc_id, text), from the smallest doc_id and offset on."""
    found = []
    for doc_id, text in rows:
        at = 0
        for line in text.split("\n"):
            pieces = [(0, line)]
            cut = [m for m in re.finditer(r"[^.!?]*[.!?]+|[^.!?]+", line)]
            if len(cut) > 1:
                pieces += [(m.start(), m[0]) for m in cut]
            for a, piece in pieces:
                own = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), piece)))
                if len(own) >= words:
                    found.append((own, doc_id, at + a, at + a + len(piece)))
            at += len(line) + 1
    first = {}
    for own, doc_id, a, _ in sorted(found, key=lambda x: x[1:]):
        first.setdefault(own, (doc_id, a))
    gone = defaultdict(set)
    for own, doc_id, a, b in found:
        if (doc_id, a) != first[own]:
            gone[doc_id].add((a, b, *first[own]))
    return gone


def test_repeated_units_by_plain_python(spark):
    random.seed(11)
    sentences = [prose(random.randint(2, 9), i).capitalize() + random.choice([".", "!", "?", "..."]) for i in range(40)]
    rows = []
    for i in range(120):
        lines = [" ".join(random.choice(sentences) for _ in range(random.randint(0, 4))) for _ in range(random.randint(1, 5))]
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, removed int")
    want = plain_units(rows, 5)
    texts = dict(rows)
    for r in repeated_units.remove_repeats(df, words=5).collect():
        assert {tuple(s) for s in r.removed} == want[r.doc_id]
        keep = [c for k, c in enumerate(texts[r.doc_id]) if not any(a <= k < b for a, b, _, _ in want[r.doc_id])]
        assert r.text == "".join(keep)
        assert "".join(texts[r.doc_id][s.start : s.end] for s in r.kept) == r.text


def test_a_long_passage_is_kept_once(spark):
    passage = prose(70, 99)
    rows = [(i, f"{prose(30, i)}.\n{passage}\n{prose(25, i + 50)}") for i in range(5)]
    left = repeated_units.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in left if passage in r.text] == [0]


def test_units_on_odd_tables(odd_docs, no_docs):
    rows = repeated_units.remove_repeats(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    # a null id ranks first; rows 1 and 2 are the same text, and the second one's rows are equal
    assert by_id[1][0].text and [r.text for r in by_id[2]] == ["", ""]
    assert all(r.text is None for r in by_id[4]) and by_id[3][0].text == ""
    assert repeated_units.remove_repeats(no_docs).count() == 0


@pytest.fixture(scope="module")
def templated(spark):
    random.seed(12)
    rows = []
    for i in range(60):
        own = "abcdefghij"[i % 10] + "klmnopqrst"[i // 10]  # words that no other document has
        body = [" ".join(w + own + "uvwx"[k] for w in prose(random.randint(10, 25), i * 7 + k).split()) for k in range(4)]
        body.insert(random.randrange(4), f"Printed on day {i} by {random.choice(WORDS)} for everyone to read")
        rows.append((i, "\n".join(body)))
    copied = "\n".join(prose(20, 400 + k) for k in range(5))
    rows += [(1000 + i, copied) for i in range(40)]
    return rows


def test_recurring_templates_are_dropped_and_copies_stay(spark, templated):
    df = spark.createDataFrame([(*r, "x") for r in templated], "doc_id long, text string, dropped string")
    rows = {r.doc_id: r for r in line_templates.drop_recurring(df).collect()}
    texts = dict(templated)
    for i, r in rows.items():
        lines = texts[i].split("\n")
        assert r.text == "\n".join(x for k, x in enumerate(lines) if k not in {d.line for d in r.dropped})
        assert [texts[i][d.start : d.end] for d in r.dropped] == [lines[d.line] for d in r.dropped]
        if i < 1000:  # the number and the name vary, the line is of one template
            assert "Printed on day" not in r.text and len(r.dropped) == 1
        else:
            assert not r.dropped
    assert len({r.dropped[0].template for i, r in rows.items() if i < 1000}) == 1


def carried_by(spark, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = line_templates.lines(df)
    names = {r.own: r.masked for r in line_templates.masked_lines(df, found.select("leaf").distinct()).collect()}
    return {names[r.own]: r.template for r in line_templates.templates(df, found).collect()}


def test_templates_fix_what_lines_share(spark):
    carried = carried_by(spark, ["a b c x q 1", "a b c x q 2", "a b c x r 3", "a b c y z w v", "d e f", "a b c k l m"])
    assert set(carried) == {"a b c x q <*>", "a b c x r <*>"} and len(set(carried.values())) == 1


def test_every_format_of_a_leaf_gets_a_template(spark):
    """However many formats share an opening, and however unequal they are."""
    rows = [f"log of day {name * 5} {'abcdefghijklmnop'[i]}" for name, n in (("q ", 16), ("r ", 8), ("s ", 4), ("t ", 2))
            for i in range(n)]
    carried = carried_by(spark, rows)
    assert len(carried) == len(rows) and len(set(carried.values())) == 4


@pytest.mark.parametrize("formats", [1, 2, 3, 6])
def test_more_formats_do_not_bring_lines_back(spark, formats):
    verbs = "opened the session now,closed a ticket today,read some mail here,left this room early,sent two files out,paid his bill late"
    rows = [f"the user account {n} {v}" for v in verbs.split(",")[:formats] for n in WORDS[:12]]
    df = spark.createDataFrame([(i, f"{r}\n{prose(30, i)} {r[::-1]}") for i, r in enumerate(rows)], "doc_id long, text string")
    dropped = [r for r in line_templates.drop_recurring(df).collect() if "the user account" not in r.text]
    assert len(dropped) == len(rows)


def test_a_common_opening_is_no_template(spark):
    rows = [f"this is the {w} {w[::-1]}x" for w in WORDS] + [f"here we go {w}" for w in WORDS]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert line_templates.templates(df, line_templates.lines(df)).count() == 0


@pytest.fixture(scope="module")
def passages(spark, tmp_path_factory):
    """Documents of words of their own, with passages that 3 and 1,000 of them hold, and near copies."""
    body = lambda i, n: [" ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}{k}" for w in WORDS)
                         .translate(str.maketrans("0123456789", "ABCDEFGHIJ")) for k in range(n)]
    rare = [f"{w} is a rare line of a passage" for w in WORDS[:4]]
    common = [f"the common {w} passage goes on" for w in WORDS[:4]]
    rows = []
    for i in range(1010):
        own = body(i, 12)
        rows.append((i, "\n".join(own[:6] + (rare if i < 3 else []) + (common if i >= 10 else []) + own[6:])))
    copied = body(2000, 12)
    rows += [(3000 + i, "\n".join([*copied, f"of copy {'abcdefghij'[i]}"])) for i in range(10)]
    rows += [(4000, "the common alpha passage goes on")]  # nothing else in it
    folder = tmp_path_factory.mktemp("passages")
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder), dict(rows), {*rare, *common}


def test_passages_of_few_and_of_many_documents_are_dropped(spark, passages):
    folder, texts, gone = passages
    for r in contract.queries()["op5_line_templates"](spark, folder).collect():
        assert r.text.split("\n") == ([x for x in texts[r.doc_id].split("\n") if x not in gone] or [""]), r.doc_id


def test_groups_of_templates_on_odd_tables(odd_docs, no_docs):
    rows = line_templates.drop_recurring(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.text and not r.dropped for r in rows if r.doc_id in (1, 2))  # copies of one text
    assert line_templates.drop_recurring(no_docs).count() == 0


def test_shingles_are_hashed_together_as_the_library_does(monkeypatch):
    random.seed(31)
    letters = "abcdefgh ABC\t\n.é漢 "
    texts = ["", " \n", "a", "one two", "Éa B c " * 9, "x" * 900 + " y z " + "w" * 300 + " q r s t u v"]
    texts += ["".join(random.choices(letters, k=random.randint(0, 900))) for _ in range(60)]
    wanted, sizes = [], []
    for text in texts:
        own = text.encode().lower().split()
        grams = [own[i : i + 5] for i in range(max(1, len(own) - 4))] if own else []
        wanted += [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
        sizes.append(len(grams))
    for chars in (1_000_000, 300):
        monkeypatch.setattr(simhash, "_CHUNK_CHARS", chars)
        found, counted = simhash._shingles(texts, 5)
        assert found.tolist() == wanted and counted.tolist() == sizes
    calls = []
    monkeypatch.setattr(simhash.xxhash, "xxh64_intdigest", lambda *a: calls.append(a) or 0)
    simhash._shingles([prose(300)], 5)
    assert not calls  # none by one


@pytest.mark.parametrize("most", [1, 14, 15, 16, 40, 700])
def test_majority_by_bit_planes(most):
    draw = np.random.default_rng(most)
    sizes = draw.integers(1, most + 1, 30)
    h = draw.integers(0, 2**64, sizes.sum(), dtype=np.uint64)
    h[: sizes[0]] = 2**64 - 1  # lanes at their fullest
    place, tiles = simhash._tiled(sizes)
    found = simhash._majority(h, sizes, place, tiles).tolist()
    for fp, own in zip(found, np.split(h, np.cumsum(sizes)[:-1])):
        assert fp == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in own) > len(own))


def test_masked_lines_are_those_of_their_split_tokens():
    random.seed(17)
    blanks = " " * 12 + "\t\r\v\f\x1c\x1f\x85\xa0  　"
    letters = blanks + "​\xad\x00" + "aB7٣\xe9漢.<" * 4
    lines = ["", " ", "a", " a", "a ", "a  b", "a b c d", "a b 1 d", "\xe9 b\xa0c d"]
    lines += ["".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(3000)]
    for line in lines:
        tokens = ["<*>" if re.search("[0-9]", t) else t for t in line.split()]
        for leading in (1, 3):
            head = f"{len(tokens)} {' '.join(tokens[:leading])}"
            leaf = int(np.uint64(xxhash.xxh64_intdigest(head.encode(), 1)).astype(np.int64))
            want = (len(tokens), " ".join(tokens).encode(), leaf) if tokens else None
            assert line_templates._tree_path(line, leading) == want


def test_small_buckets_share_machine_words(monkeypatch):
    """Bit planes hold the members of buckets, not room for 64 of each."""
    fps = np.arange(400, dtype=np.uint64).reshape(200, 2, 1)
    widest, pack = [], np.packbits
    monkeypatch.setattr(simhash.np, "packbits", lambda a, **how: widest.append(a.size) or pack(a, **how))
    found = simhash.close_pairs(list(fps), 1)
    assert [(i.tolist(), j.tolist()) for i, j in found] == [([0], [1])] * 200  # 2k and 2k + 1
    assert max(widest) < 400 + 64


def test_only_lines_of_shared_leaves_and_one_document_of_each_text_go_on(spark, monkeypatch):
    texts = [f"printed here for {w} and others\n{prose(20, 300 + i)}" for i, w in enumerate(WORDS[:8])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 5)], "doc_id long, text string")
    df = df.unionByName(spark.createDataFrame([(900 + i, f"{x}q {prose(25, 900 + i)}") for i, x in enumerate("abcdefghij")], df.schema))
    seen = {}
    in_groups, groups_of_texts = line_templates._in_groups, simhash.groups_of_texts

    def named_lines(docs, named, least):
        seen["lines"] = {r._llm_id for r in named.select("_llm_id").collect()}
        return in_groups(docs, named, least)

    def fingerprinted(docs, **how):
        seen["documents"] = docs.count()
        return groups_of_texts(docs, **how)

    monkeypatch.setattr(line_templates, "_in_groups", named_lines)
    monkeypatch.setattr(line_templates.simhash, "groups_of_texts", fingerprinted)
    rows = line_templates.drop_recurring(df).collect()
    assert {r.doc_id for r in rows if r.dropped} == set(range(40))
    assert seen == {"lines": set(range(40)), "documents": 8}
