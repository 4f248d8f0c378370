from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from evalsieve.functions import overlap, text

SEED = 7


def values(spark, rows, *columns):
    schema = ", ".join(f"c{i} {kind}" for i, kind in enumerate(_kinds(rows[0])))
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [tuple(r) for r in df.select(*columns).collect()]


def _kinds(row):
    return ["string" if isinstance(v, str) else "double" for v in row]


def random_texts(n, alphabet, longest=40):
    rng = random.Random(SEED)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(n)]


def test_tokens_follow_python_split_for_every_bmp_character(spark):
    chars = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    found = values(spark, [(f"a{c}b",) for c in chars], text.words("c0"))
    wrong = [c for c, (got,) in zip(chars, found) if got != f"a{c}b".split()]
    assert wrong == []


def test_whitespace_set_is_pythons():
    assert sorted(text.WHITESPACE_CHARS) == [chr(c) for c in range(0x110000) if chr(c).isspace()]


def test_tokenize_and_strip(spark):
    texts = random_texts(3000, "aB é.\t\n\x1f\u2003") + ["", " ", "\u3000x\u3000"]
    found = values(spark, [(t,) for t in texts], text.tokenize("c0"), text.strip("c0"))
    assert found == [(t.lower().split(), t.strip()) for t in texts]


def test_first_words(spark):
    texts = random_texts(1000, "ab  \n")
    for n in (0, 1, 3):
        found = values(spark, [(t,) for t in texts], text.first_words("c0", F.lit(n)))
        assert found == [(t.split()[:n],) for t in texts]


def test_prefix_and_tail(spark):
    rng = random.Random(SEED)
    rows = [
        ("x" * rng.randint(0, 300) + "é𝒳", rng.choice([1.5, 1.0, 0.8, 0.6, 0.4, 0.29, 0.1, 0.0]))
        for _ in range(3000)
    ]
    shown = text.prefix("c0", F.col("c1"))
    found = values(spark, rows, shown, text.tail(F.col("c0"), shown))
    for (q, r), (got, rest) in zip(rows, found):
        size = len(q) if r >= 1 else max(1, int(len(q) * r))
        assert (got, rest) == (q[:size], q[size:])


def test_prefix_examples(spark):
    found = values(spark, [("abcde", r) for r in (1.0, 0.4, 0.1)], text.prefix("c0", F.col("c1")))
    assert [r[0] for r in found] == ["abcde", "ab", "a"]


def last_box(t: str) -> str:
    """Brute force: shortest balanced body after the last box."""
    at = t.rfind(r"\boxed{")
    rest = t[at + 7 :] if at >= 0 else ""
    for end in range(len(rest)):
        if rest[end] == "}" and rest[:end].count("{") == rest[:end].count("}"):
            return rest[:end].strip()
    return ""


def test_boxed_matches_brute_force(spark):
    rng = random.Random(SEED)
    parts = [r"\boxed{", "{", "}", "a", " ", r"\boxed", "\n", "1", r"\frac"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(20_000)]
    found = values(spark, [(t,) for t in texts], text.boxed("c0"))
    assert [f[0] for f in found] == [last_box(t) for t in texts]


def test_boxed_examples(spark):
    cases = {
        r"a \boxed{1} b \boxed{\frac{1}{2}}": r"\frac{1}{2}",
        r"\boxed{1": "",
        "no box": "",
        r"\boxed{1} \boxed{2": "",
        r"\boxed{}": "",
        r"\boxed{ 7 } and }": "7",
    }
    found = values(spark, [(t,) for t in cases], text.boxed("c0"))
    assert [f[0] for f in found] == list(cases.values())


def normal_form(a: str) -> str:
    bare = a.strip().replace("$", "").strip()
    box = re.fullmatch(r"\\boxed\{(.*)\}", bare)
    bare = box.group(1).strip() if box else bare
    while bare.endswith("."):
        bare = bare[:-1]
    return " ".join(bare.split())


def test_normalize_matches_python(spark):
    rng = random.Random(SEED)
    parts = [r"\boxed{", "}", "$", ".", " ", "\n", "5", "x", "\u2003", "\r", "="]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 9))) for _ in range(20_000)]
    texts += [r" $\boxed{ 5 }$ ", "5...", "x  =  2 ."]
    found = [f[0] for f in values(spark, [(t,) for t in texts], text.normalize_answer("c0"))]
    assert found == [normal_form(t) for t in texts]
    assert found[-3:] == ["5", "5", "x = 2"]


def test_names_and_prompt(spark):
    rows = [("a/b:c/",), ("plain",), ("x//",), ("dir/eval.v1.json",)]
    found = values(
        spark,
        rows,
        text.short_model_name("c0"),
        text.match_set_name("c0"),
        text.file_stem("c0"),
        text.build_prompt("c0"),
    )
    assert [f[0] for f in found] == ["b_c", "plain", "", "eval.v1.json"]
    assert found[3][1] == "dir/eval_v1_json" and found[3][2] == "eval.v1"
    assert found[1][3] == (
        "You are a math problem solving assistant.\nSolve the following problem step by step "
        "and put the final answer in \\boxed{}.\n\nProblem:\nplain\n\nSolution:\n"
    )


def lcs_table(a: list[str], b: list[str]) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            best[i][j] = (
                best[i - 1][j - 1] + 1 if x == y else max(best[i - 1][j], best[i][j - 1])
            )
    return best[-1][-1]


def test_lcs_matches_table(spark):
    rng = random.Random(SEED)
    rows = [
        tuple(" ".join(rng.choices("abcdef", k=rng.randint(0, 90))) for _ in range(2))
        for _ in range(1500)
    ]
    found = values(spark, rows, overlap.lcs_length(F.col("c0"), F.col("c1")))
    assert [f[0] for f in found] == [lcs_table(a.split(), b.split()) for a, b in rows]


def test_overlap_tokens_and_score(spark):
    rows = [("The cat's  hat!", "the hat"), ("", "x"), ("é", "a")]
    left, right = overlap.overlap_tokens("c0"), overlap.overlap_tokens("c1")
    n, m = overlap.token_count(left), overlap.token_count(right)
    found = values(
        spark, rows, left, n, m, overlap.f_measure(overlap.lcs_length(left, right), n, m)
    )
    assert found[0][:3] == ("the cat s hat", 4, 2)
    assert found[0][3] == 2 * 1.0 * 0.5 / 1.5
    assert [f[1:] for f in found[1:]] == [(0, 1, 0.0), (0, 1, 0.0)]
