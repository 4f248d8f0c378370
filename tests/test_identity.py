from __future__ import annotations

import json
import random
from hashlib import md5

import pytest

from evalsieve.operators.identity import fingerprints
from evalsieve.plans import jobs

ROWS = "row_idx long, prompt string, answer string, source string, id string"


def plain(rows):
    """By Python's whole numbers of any size."""

    def text(row):
        return ";".join("-" if v is None else f"{len(v)}:{v}" for v in row[1:])

    def number(value):
        return int(md5(value.encode()).hexdigest(), 16)

    content = sum(number(text(r)) for r in rows) % 2**128
    placed = sum(number(f"{'-' if r[0] is None else r[0]};{text(r)}") for r in rows) % 2**128
    return len(rows), f"{content:032x}", f"{placed:032x}"


def test_sums_by_whole_numbers(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice(["", "a", None, "é\n😀", "x;1:y"]), draw.choice([None, "-", "4"]), "s" * draw.randint(0, 3), str(i % 5))
            for i in range(500)]
    rows.append((None, None, None, None, None))
    df = spark.createDataFrame(rows, ROWS).repartition(7)
    assert tuple(fingerprints(df).first()) == plain(rows)
    assert tuple(fingerprints(df.limit(0)).first()) == plain([])


def test_what_the_fingerprints_tell(spark):
    def of(rows):
        return fingerprints(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ROWS)).first()

    a, b, c = ("one", "1", "s", "i"), ("two", None, "s", "j"), ("on", "e1", "s", "i")
    base = of([a, b, a])
    assert of([a, a, b]).content_fingerprint == base.content_fingerprint
    assert of([a, a, b]).placed_fingerprint != base.placed_fingerprint
    assert of([a, b]).content_fingerprint != base.content_fingerprint  # repeated rows count
    assert of([c, b, a]).content_fingerprint != base.content_fingerprint  # no text moves between columns
    assert of([("two", "", "s", "j")]).content_fingerprint != of([b]).content_fingerprint  # null is not empty


def test_cleaning_refuses_another_training_set(spark, tmp_path):
    copied = "a run of words that stands in the benchmark and in the rows alike today"
    rows = [{"prompt": f"{copied if i == 3 else 'other text'} {i}", "answer": "", "source": "s", "id": str(i)} for i in range(20)]
    bench = tmp_path / "bench.json"
    bench.write_text(json.dumps([{"prompt": copied, "answer": "", "source": "b", "id": "b"}]))

    def write(name, some):
        path = tmp_path / name
        path.write_text("".join(json.dumps(r) + "\n" for r in some))
        return str(path)

    out = str(tmp_path / "out")
    seen = write("seen.jsonl", rows)
    jobs.detect(spark, seen, [str(bench)], out, form="lines", pairs=False)
    turned = write("turned.jsonl", [rows[3], *rows[:3], *rows[4:]])
    with pytest.raises(ValueError, match="order"):
        jobs.clean(spark, turned, out, f"{out}/clean", form="lines")
    edited = write("edited.jsonl", [*rows[:-1], {**rows[-1], "prompt": "new"}])
    with pytest.raises(ValueError, match="edited"):
        jobs.clean(spark, edited, out, f"{out}/clean", form="lines")
    with pytest.raises(ValueError, match="20 training rows"):
        jobs.clean(spark, write("short.jsonl", rows[1:]), out, f"{out}/clean", form="lines")
    jobs.clean(spark, seen, out, f"{out}/clean", form="lines")
    kept = spark.read.json(f"{out}/clean/decontaminated")
    assert {r["id"] for r in kept.collect()} == {str(i) for i in range(20) if i != 3}
