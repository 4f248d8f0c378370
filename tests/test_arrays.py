from __future__ import annotations

import json
import random

import pyarrow as pa
import pytest

from evalsieve.sources import arrays, files

SCHEMA = "prompt string, answer string, source string, id string"


def write(path, rows, **how):
    path.write_text(json.dumps(rows, **how), encoding="utf-8")
    return str(path)


def odd_rows(n, seed=1):
    draw = random.Random(seed)
    bits = ['}', '{', '"', '\\', '\\"', ',', '[', ']', 'é😀', ' ', '\n', 'a', '},{', '\\\\', '"}', r'\boxed{1}', '﻿']
    text = lambda: "".join(draw.choices(bits, k=draw.randint(0, 25)))
    return [{"prompt": text(), "answer": text(), "id": str(i)} for i in range(n)]


@pytest.fixture
def split_at(spark):
    """Cut files into ranges of so many bytes."""

    def cut(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield cut
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path):
    rows = arrays.read_array_rows(spark, path, SCHEMA).collect()
    assert sorted(r["_at"] for r in rows) == list(range(len(rows)))
    return [{k: r[k] for k in ("prompt", "answer", "id")} for r in sorted(rows, key=lambda r: r["_at"])]


@pytest.mark.parametrize("ascii", [True, False])
@pytest.mark.parametrize("indent", [None, 2])
def test_odd_texts_in_ranges_of_any_size(spark, tmp_path, split_at, ascii, indent):
    rows = odd_rows(40)
    path = write(tmp_path / "a.json", rows, ensure_ascii=ascii, indent=indent)
    for size in (300, 10**6):
        split_at(size)
        assert read(spark, path) == rows


def ranges_of(text, borders):
    """Pieces as a text reader of split files gives them: each to the range it begins in."""
    at, out = 0, []
    for piece in text.split("}"):
        if at < len(text):
            out.append((max(b for b in [0, *borders] if b <= at), piece))
        at += len(piece) + 1
    return out


def cut_plainly(text, borders):
    """The functions of the two passes, without Spark, on one range after the other."""
    found, parts, ends, state = {}, {}, 0, (0, 0, 0)
    pieces = ranges_of(text, borders)
    for start in sorted({s for s, _ in pieces}):
        own = [p for s, p in pieces if s == start]
        batch = pa.record_batch([["f"] * len(own), [start] * len(own), own], ["_path", "_start", "value"])
        (summed,) = [b.to_pylist()[0] for b in arrays._summed(iter([batch]))]
        inside, depth, ended = state
        full = batch.append_column("i", pa.array([inside] * len(own))).append_column(
            "d", pa.array([depth] * len(own))).append_column("e", pa.array([ended] * len(own)))
        for out in arrays._cut(iter([full])):
            for r in out.to_pylist():
                if r["_at"] is None:
                    ends += 1
                elif r["_range"] is None:
                    found[r["_at"]] = r["text"]
                else:
                    parts.setdefault(r["_at"], []).append((r["_range"], r["text"]))
        n = {e["depth"]: e["n"] for e in summed[f"ends{inside}"]}.get(-depth, 0)
        state = (inside ^ summed["turn"], depth + summed[f"change{inside}"], ended + n)
    assert ends == 1
    found |= {at: "".join(t for _, t in sorted(own)) for at, own in parts.items()}
    return [json.loads(found[i].lstrip("\ufeff \n[,")) for i in range(len(found))]


def test_every_split_offset():
    rows = [{"prompt": 'a "}\\', "answer": "{", "id": "0"}, {"prompt": "", "answer": "}{", "id": "1"}, {"prompt": "x}", "answer": '"', "id": "2"}]
    for text in (json.dumps(rows), json.dumps(rows, indent=1)):
        for a in range(len(text)):
            assert cut_plainly(text, [a]) == rows
            assert cut_plainly(text, [a, min(len(text) - 1, a + 9), min(len(text) - 1, a + 31)]) == rows
    draw = random.Random(6)
    for n in range(200):
        rows = odd_rows(5, n)
        text = json.dumps(rows, ensure_ascii=False)
        assert cut_plainly(text, sorted(draw.sample(range(1, len(text)), 6))) == rows


def test_effects_compose_like_a_plain_reader():
    """Whatever stands before a piece: its effect is what reading character by character does."""
    draw = random.Random(4)
    for _ in range(3000):
        text = json.dumps(odd_rows(3, draw.random()), ensure_ascii=False)
        cursor, inside, depth, escaped = arrays.Cursor(), False, 0, False
        for piece in text.split("}")[:-1]:
            for c in piece + "}":
                if escaped:
                    escaped = False
                elif inside:
                    escaped = c == "\\"
                    inside = c != '"'
                elif c == '"':
                    inside = True
                else:
                    depth += {"{": 1, "}": -1}.get(c, 0)
            ended = cursor.step(piece)
            assert (cursor.inside, cursor.depth) == (int(inside), depth)
            assert ended == (depth == 0 and not inside)
        assert cursor.ended == 3


def test_nested_objects_unknown_fields_and_empty_arrays(spark, tmp_path, split_at):
    split_at(40)
    path = tmp_path / "n.json"
    path.write_text(' \n[ {"prompt": "p", "more": {"x": [{"y": {}}, "}"]}, "id": "1"} ,\n {"id": null, "prompt": "q"}\n ] \n')
    found = arrays.read_array_rows(spark, str(path), SCHEMA).orderBy("_at").collect()
    assert [(r.prompt, r.id, r.answer) for r in found] == [("p", "1", None), ("q", None, None)]
    for text in ("[]", " [ ] \n"):
        path.write_text(text)
        assert arrays.read_array_rows(spark, str(path), SCHEMA).count() == 0


@pytest.mark.parametrize("text", [
    '[{"prompt": "a"}', '[{"prompt": "a"}, ', '[{"prompt": "a"}, {"prompt": "b"', '[{"prompt": "a"} {"prompt": "b"}]', "[1, 2]",
    '[{"prompt": "a"}, null, {"prompt": "b"}]', '[{"prompt": a}]', '{"prompt": "a"}', '[{"prompt": "a"}]x',
])
def test_faulty_arrays_fail(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(Exception):
        arrays.read_array_rows(spark, str(path), SCHEMA).collect()


def test_one_file_is_read_by_many_tasks(spark, tmp_path, split_at):
    rows = odd_rows(1500, 2)
    path = write(tmp_path / "big.json", rows)
    split_at(20_000)
    pieces = arrays._pieces(spark, path)
    assert pieces.rdd.getNumPartitions() > 4
    assert read(spark, path) == rows


def test_positions_over_files(spark, tmp_path, split_at, all_sizes):
    split_at(1000)
    parts = [odd_rows(n, n) for n in (7, 1, 12)]
    for i, rows in enumerate(parts):
        write(tmp_path / f"{i}.json", rows)
    found = files.read_training(spark, str(tmp_path)).orderBy("row_idx").collect()
    wanted = [r for rows in parts for r in rows]
    assert [r.row_idx for r in found] == list(range(20))
    assert [(r.prompt, r.id) for r in found] == [(r["prompt"], r["id"]) for r in wanted]
    items = files.read_benchmarks(spark, [str(tmp_path / "0.json"), str(tmp_path / "2.json")]).collect()
    assert {(r.benchmark, r.test_idx, r.id) for r in items} == {
        (str(k), i, r["id"]) for k in (0, 2) for i, r in enumerate(parts[k])}
