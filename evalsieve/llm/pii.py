"""Personal data: fixed rules, and a semi-Markov conditional random field.

The field labels whole spans. A window is a run of chunks that hold a digit or an at sign;
its tokens are cut into segments, each ordinary (one token) or of a kind (up to MOST_TOKENS
tokens). A segment is scored by features of the whole span, and dynamic programming
chooses boundaries and kinds together. It learns from a bounded sample of windows, labelled
by the rules, and then finds spans that the rules' fixed order and forms miss.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm.common import Spans, chunks, ids_and_texts, map_batches
from evalsieve.scale import settle

#: The rules' kinds, in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
#: Labelled windows that the field learns from, and tokens of such a window at most.
SAMPLE = 600
SAMPLE_TOKENS = 48
#: Tokens of an entity at most; the kinds' longest forms have 13.
MOST_TOKENS = 16
#: Probability that an added span needs.
CONFIDENCE = 0.5
#: Longer windows are decoded in stretches of so many tokens, with more beside them on both
#: sides, so that no entity and hardly any evidence is cut.
STRETCH_TOKENS = 512
MARGIN_TOKENS = 4 * MOST_TOKENS
#: Characters of windows whose features are held at a time.
DECODED_CHARS = 20_000
ROUNDS = 50

_HASHED = 1 << 14
_LABELS = 1 + len(KINDS)  # the first is for ordinary tokens
_LOW = -1e30

_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile("[0-9@]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)

_SPAN = "struct<kind:string,start:long,end:long>"
_WINDOW = "struct<start:long,text:string,left:string,right:string>"


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + doubled) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches in linear time: from each at sign back over its local part."""
    free = 0  # end of the match before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def rules(text: str) -> list[tuple[int, int, int]]:
    """Kind's place, start and end of the rules' matches, in that order."""
    if not _TRIGGER.search(text):
        return []
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13:
            digits = re.sub("[^0-9]", "", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((3, *m.span()))
    return found


def windows(text: str) -> list[dict]:
    """Runs of chunks with a digit or an at sign, one or two spaces apart, and the chunks beside."""
    if not _TRIGGER.search(text):
        return []
    out: list[dict] = []
    pieces: list[list[str]] = []  # of each window
    before, after_window, end = "", False, 0
    for m in _CHUNK.finditer(text):
        chunk = m[0]
        if _TRIGGER.search(chunk):
            gap = text[end : m.start()]
            if after_window and gap in (" ", "  "):
                pieces[-1] += [gap, chunk]
            else:
                out.append({"start": m.start(), "left": before[-20:], "right": ""})
                pieces.append([chunk])
            after_window, end = True, m.end()
        else:
            if after_window:
                out[-1]["right"] = chunk[:20]
            after_window, before = False, chunk
    return [{**w, "text": "".join(own)} for w, own in zip(out, pieces)]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the rules' spans and the windows of every document."""

    def run(columns):
        base, wins = [], []
        for text in columns["text"]:
            text = text or ""
            base.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in rules(text)])
            wins.append(windows(text))
        return {"doc_id": columns["doc_id"], "base": base, "windows": wins}

    return map_batches(
        ids_and_texts(docs), run, f"doc_id long, base array<{_SPAN}>, windows array<{_WINDOW}>"
    )


# -- segments and features ------------------------------------------------------------------


def _class(c: str) -> str:
    """A window ends at white space or with the text, so both look alike."""
    return "_" if not c or c.isspace() else "a" if c.isalpha() else "9" if c.isdigit() else c


def _number(feature: str) -> int:
    return 1 + zlib.crc32(feature.encode("utf-8")) % (_HASHED - 1)  # 0 is for none


class Window:
    """Tokens of a window, and its possible segments with the features of their spans."""

    def __init__(self, text: str, left: str, right: str):
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts = [a for a, _ in spans]
        self.ends = [b for _, b in spans]
        tokens = [text[a:b] for a, b in spans]
        kinds = ["a" if t[0].isalpha() else "9" if t[0] in "0123456789" else t for t in tokens]
        self.ordinary = [
            [_number(f"o:{k}:{len(t) if k == '9' else ''}"),
             _number(f"o-:{kinds[i - 1] if i else ''}{k}{kinds[i + 1] if i + 1 < len(tokens) else ''}")]
            for i, (t, k) in enumerate(zip(tokens, kinds))
        ]
        beside = re.sub(r"\W", "", left.lower())
        self.segments: list[tuple[int, int, list[int]]] = []  # end (tokens), tokens, features
        for i, first in enumerate(tokens):
            if not (first[0].isalnum() or first in "+("):
                continue
            shape = coarse = digits = ""
            marks: set[str] = set()
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                t, k = tokens[j], kinds[j]
                shape += str(len(t)) if k == "9" else k
                coarse += k
                if k == "9":
                    digits += t
                elif k != "a":
                    marks.add(k)
                if not t[0].isalnum() or not (digits or "@" in marks):
                    continue
                known = [
                    f"s:{shape}", f"c:{coarse}", f"n:{len(digits)}", f"m:{''.join(sorted(marks))}",
                    f"b:{_class(text[max(0, self.starts[i] - 1) : self.starts[i]])}{kinds[i]}",
                    f"e:{_class(text[self.ends[j] : self.ends[j] + 1])}{k}",
                    f"l:{beside}" if i == 0 else "",
                    f"d:{j - i + 1}",
                    f"v:{13 <= len(digits) <= 19 and luhn(digits)}{marks <= {' ', '-'} and 'a' not in coarse}",
                    f"o:{coarse == '9.9.9.9' and all(map(_octet, text[self.starts[i] : self.ends[j]].split('.')))}",
                    f"t:{'@' in coarse and '.' in coarse.partition('@')[2]}{coarse.count('@')}{' ' in marks}",
                ]
                self.segments.append((j + 1, j - i + 1, [_number(f) for f in known if f]))


_FEATURES = 11


class Batch:
    """Padded windows: their segments' scores by end, length and label."""

    def __init__(self, wins: list[Window]):
        self.sizes = np.array([len(w.starts) for w in wins])
        self.n, self.t = len(wins), int(self.sizes.max())
        rows = [(n, e, d, 1) for n, w in enumerate(wins) for e, d, _ in w.segments]
        rows += [(n, e, 1, 0) for n, w in enumerate(wins) for e in range(1, len(w.starts) + 1)]
        self.at = np.array(rows, dtype=np.int64).reshape(-1, 4)
        features = np.zeros((len(rows), _FEATURES), dtype=np.int64)
        i = 0
        for w in wins:
            for _, _, own in w.segments:
                features[i, : len(own)] = own
                i += 1
        for w in wins:
            for own in w.ordinary:
                features[i, : len(own)] = own
                i += 1
        self.features, self.typed = features, self.at[:, 3] == 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        own = weights[:, self.features].sum(axis=2)  # label, row
        own = np.where((np.arange(_LABELS)[:, None] > 0) == self.typed, own, _LOW)
        out = np.full((self.n, self.t + 1, MOST_TOKENS + 1, _LABELS), _LOW)
        n, e, d, _ = self.at.T
        for typed in (True, False):  # a one-token segment may be ordinary or of a kind
            k = self.typed == typed
            labels = slice(1, None) if typed else slice(0, 1)
            out[n[k], e[k], d[k], labels] = own[labels, k].T
        return out


def _log_sum(x: np.ndarray, axis) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _forward(scores: np.ndarray, pairs: np.ndarray, reduce) -> tuple[np.ndarray, np.ndarray]:
    """Totals of all segmentations up to each end by last label, and before each start by next label."""
    n, t1 = scores.shape[:2]
    upto = np.full((n, t1, _LABELS), _LOW)
    before = np.full((n, t1, _LABELS), _LOW)
    before[:, 0] = 0
    for e in range(1, t1):
        d = np.arange(1, min(e, MOST_TOKENS) + 1)
        upto[:, e] = reduce(scores[:, e, d] + before[:, e - d], 1)
        before[:, e] = reduce(upto[:, e, :, None] + pairs, 1)
    return upto, before


def _backward(scores: np.ndarray, pairs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Totals after each end by its label, and from each start on by its label."""
    n, t1 = scores.shape[:2]
    after = np.full((n, t1, _LABELS), _LOW)
    onward = np.full((n, t1, _LABELS), _LOW)
    for s in range(t1 - 1, -1, -1):
        d = np.arange(1, min(t1 - 1 - s, MOST_TOKENS) + 1)
        if len(d):
            onward[:, s] = _log_sum(scores[:, s + d, d] + after[:, s + d], 1)
            after[:, s] = _log_sum(pairs + onward[:, s, None, :], 2)
        after[sizes == s, s] = 0
    return after, onward


def _posterior(batch: Batch, weights, pairs):
    scores = batch.scores(weights)
    upto, before = _forward(scores, pairs, _log_sum)
    after, onward = _backward(scores, pairs, batch.sizes)
    rows = np.arange(batch.n)
    total = _log_sum(upto[rows, batch.sizes], 1)
    n, e, d, _ = batch.at.T
    own = np.exp(np.minimum(scores[n, e, d] + before[n, e - d] + after[n, e] - total[n, None], 0))
    own[:, 0] *= ~batch.typed
    own[:, 1:] *= batch.typed[:, None]
    return scores, own, (upto, onward, total)


def fit(wins: list[Window], gold: list[list[tuple[int, int, int]]], rounds: int = ROUNDS):
    """Weights by label and feature, and of label pairs: the conditional likelihood of the gold
    segments (end, tokens, label) by gradient steps, with a small ridge."""
    batch = Batch(wins)
    want = np.zeros((len(batch.at), _LABELS))
    row = {(n, e, d, k): i for i, (n, e, d, k) in enumerate(map(tuple, batch.at.tolist()))}
    follow = np.zeros((_LABELS, _LABELS))
    for n, segments in enumerate(gold):
        covered, labelled = set(), []
        for e, d, label in segments:
            want[row[n, e, d, 1], label] = 1
            covered.update(range(e - d, e))
            labelled.append((e, label))
        for e in range(1, batch.sizes[n] + 1):
            if e - 1 not in covered:
                want[row[n, e, 1, 0], 0] = 1
                labelled.append((e, 0))
        labels = [label for _, label in sorted(labelled)]
        np.add.at(follow, (labels[:-1], labels[1:]), 1)
    weights, pairs = np.zeros((_LABELS, _HASHED)), np.zeros((_LABELS, _LABELS))
    seen_w, seen_p = np.full_like(weights, 1e-6), np.full_like(pairs, 1e-6)
    flat = batch.features.ravel()
    for _ in range(rounds):
        _, own, (upto, onward, total) = _posterior(batch, weights, pairs)
        error = want - own
        slope = np.stack([
            np.bincount(flat, np.repeat(error[:, y], _FEATURES), minlength=_HASHED) for y in range(_LABELS)
        ]) - 0.002 * weights
        slope[:, 0] = 0
        met = upto[..., :, None] + pairs + onward[..., None, :] - total[:, None, None, None]
        slope_p = follow - np.exp(np.minimum(met[:, 1:], 0)).sum(axis=(0, 1)) - 0.01 * pairs
        seen_w += slope**2
        seen_p += slope_p**2
        weights += slope / np.sqrt(seen_w)
        pairs += slope_p / np.sqrt(seen_p)
    return weights, pairs


def decode(wins: list[Window], weights, pairs) -> list[list[tuple[int, int, int, float]]]:
    """Of each window the entities of the best segmentation: first token, end, label, probability."""
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in wins]
    order = sorted(range(len(wins)), key=lambda i: len(wins[i].starts))
    at = 0
    while at < len(order):
        size = max(1, 20_000 // max(1, len(wins[order[min(at + 255, len(order) - 1)]].starts)))
        chosen = order[at : at + min(size, 256)]
        at += len(chosen)
        batch = Batch([wins[i] for i in chosen])
        scores, own, _ = _posterior(batch, weights, pairs)
        sure = {(n, e, d): own[i] for i, (n, e, d, k) in enumerate(map(tuple, batch.at.tolist())) if k}
        upto, before = _forward(scores, pairs, lambda x, axis: x.max(axis=axis))
        for n, i in enumerate(chosen):
            e = int(batch.sizes[n])
            label = int(upto[n, e].argmax())
            while e:
                d = np.arange(1, min(e, MOST_TOKENS) + 1)
                d = int(d[(scores[n, e, d, label] + before[n, e - d, label]).argmax()])
                if label:
                    out[i].append((e - d, e, label, float(sure[n, e, d][label])))
                e -= d
                label = int((upto[n, e] + pairs[:, label]).argmax())
    return out


def stretches(text: str, left: str) -> Iterator[tuple[str, str, int, int, int]]:
    """What a window is decoded in: text, what stands left of it, its place in the window, and
    from where to where entities that begin there count. A window of few tokens is one."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if len(spans) <= STRETCH_TOKENS:
        yield text, left, 0, 0, len(text)
        return
    for core in range(0, len(spans), STRETCH_TOKENS):
        first = max(0, core - MARGIN_TOKENS)
        last = min(len(spans), core + STRETCH_TOKENS + MARGIN_TOKENS)
        a, b = spans[first][0], spans[last - 1][1]
        until = min(len(spans), core + STRETCH_TOKENS)
        yield text[a:b], left if a == 0 else text[max(0, a - 20) : a], a, spans[core][0], spans[until - 1][1]


def entities(wins: list[tuple[str, str]], weights, pairs) -> list[list[tuple[int, int, int, float]]]:
    """Of each window (text, what stands left of it) the entities of the best segmentation:
    start, end, label, probability. Time is linear in the text; what is held is bounded."""
    number: dict[tuple[str, str], int] = {}
    parts = []
    for i, (text, left) in enumerate(wins):
        for part, beside, at, since, until in stretches(text, left):
            parts.append((i, number.setdefault((part, beside), len(number)), at, since, until))
    keys = list(number)
    decoded: list[list[tuple[int, int, int, float]]] = []
    for a, b in chunks([text for text, _ in keys], DECODED_CHARS):
        made = [Window(text, beside, "") for text, beside in keys[a:b]]
        for win, found in zip(made, decode(made, weights, pairs)):
            decoded.append([(win.starts[x], win.ends[y - 1], label, sure) for x, y, label, sure in found])
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in wins]
    for i, own, at, since, until in parts:
        for start, end, label, sure in sorted(decoded[own]):
            if since <= at + start < until and not (out[i] and at + start < out[i][-1][1]):
                out[i].append((at + start, at + end, label, sure))
    return out


# -- the operator -----------------------------------------------------------------------------


def _gold(win: Window, start: int, base: list[dict]) -> list[tuple[int, int, int]] | None:
    """The rules' spans as segments; of overlapping ones the first kind. None if one fits no tokens."""
    first = {start + a: i for i, a in enumerate(win.starts)}
    last = {start + b: i + 1 for i, b in enumerate(win.ends)}
    known = {(e, d) for e, d, _ in win.segments}
    found, taken = [], set()
    for span in sorted(base, key=lambda s: (KINDS.index(s["kind"]), s["start"])):
        if span["end"] <= start or span["start"] >= start + (win.ends[-1] if win.ends else 0):
            continue
        i, j = first.get(span["start"]), last.get(span["end"])
        if i is None or j is None or (j, j - i) not in known:
            return None
        if taken.isdisjoint(range(i, j)):
            taken.update(range(i, j))
            found.append((j, j - i, 1 + KINDS.index(span["kind"])))
    return found


def learn(scanned: DataFrame, sample: int = SAMPLE):
    """Weights from at most `sample` windows, half with and half without a rule's span, those
    with the smallest hashes. None if no window has one."""
    each = scanned.select("base", F.explode("windows").alias("w")).where(F.length("w.text") <= 4 * SAMPLE_TOKENS)
    inside = F.filter("base", lambda s: (s["start"] < F.col("w.start") + F.length("w.text")) & (s["end"] > F.col("w.start")))
    each = each.select("w", inside.alias("base"))
    drawn = lambda df: df.distinct().orderBy(F.xxhash64("w"), "w.start", "w.text").limit(sample // 2)
    # where several chunks stand together the rules read across them, so what they miss there
    # is no evidence against an entity
    without = each.where((F.size("base") == 0) & ~F.contains("w.text", F.lit(" ")))
    chosen = drawn(each.where(F.size("base") > 0)).unionByName(drawn(without))

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        wins, gold = [], []
        for w, base in zip(rows["w"], rows["base"]):
            win = Window(w["text"], w["left"], w["right"])
            own = _gold(win, w["start"], list(base))
            if own is not None and len(win.starts) <= SAMPLE_TOKENS:
                wins.append(win)
                gold.append(own)
        if not any(gold):
            return pd.DataFrame({"weights": [], "pairs": []})
        weights, pairs = fit(wins, gold)
        return pd.DataFrame({"weights": [weights.tobytes()], "pairs": [pairs.tobytes()]})

    model = chosen.groupBy().applyInPandas(train, "weights binary, pairs binary").first()
    if model is None:
        return None
    return (
        np.frombuffer(model["weights"]).reshape(_LABELS, _HASHED),
        np.frombuffer(model["pairs"]).reshape(_LABELS, _LABELS),
    )


def find_pii(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans: the rules' spans, and all spans with those that the field adds.

    Spans have kind, start and end (code points, end exclusive), by kind and then start; an
    added span's kind follows "like_", and it overlaps no base span. Entities hold a digit or
    an at sign. A null text counts as empty, repeated rows give repeated results; if the
    rules find nothing there is nothing to learn from, and nothing is added.
    """
    scanned = settle(scan(docs))
    model = learn(scanned, sample)
    if model is None:
        return scanned.select("doc_id", "base", F.col("base").alias("spans"))
    weights, pairs = (m.astype(np.float32) for m in model)
    rank = dict(zip((*KINDS, *(f"like_{k}" for k in KINDS)), count()))

    def run(columns):
        distinct: dict[tuple, int] = {}
        for own in columns["windows"]:
            for w in own:
                distinct.setdefault((w["text"], w["left"]), len(distinct))
        found = entities(list(distinct), weights.astype(float), pairs.astype(float))
        spans = []
        for base, own in zip(columns["base"], columns["windows"]):
            all_spans = list(base)
            known = Spans((s["start"], s["end"]) for s in base)
            for w in own:
                for a, b, label, sure in found[distinct[w["text"], w["left"]]]:
                    start, end = w["start"] + a, w["start"] + b
                    if sure >= CONFIDENCE and not known.touch(start, end):
                        all_spans.append({"kind": f"like_{KINDS[label - 1]}", "start": start, "end": end})
            spans.append(sorted(all_spans, key=lambda s: (rank[s["kind"]], s["start"])))
        return {"doc_id": columns["doc_id"], "base": columns["base"], "spans": spans}

    return map_batches(scanned, run, f"doc_id long, base array<{_SPAN}>, spans array<{_SPAN}>")
