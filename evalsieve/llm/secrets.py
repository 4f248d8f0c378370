"""Secret scans: fixed rules, and formats inferred from what the rules have found.

The values that the rules match are labelled credentials. Of each kind a bounded sample
is turned into a prefix tree over character classes with counts; states whose ending and
following frequencies are statistically compatible (a Hoeffding bound, checked down the
tree) are merged into a probabilistic automaton. A further automaton learns ordinary long
tokens. Every token that could be a credential is then scored by the likelihood of its
format; tokens that a kind explains far better than ordinary text become spans.
"""

from __future__ import annotations

import math
import re
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm.common import Spans, gaps, ids_and_texts, map_batches, rewrite
from evalsieve.scale import settle

#: The rules' kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex")
#: Distinct values of each kind, and of ordinary tokens, that the automata learn from.
SAMPLE = 1000
#: Longest value that a sample takes, in characters.
SAMPLE_CHARS = 256
#: Characters of a candidate at least.
CANDIDATE_CHARS = 8
#: How much likelier than ordinary a candidate must be: e to this power, and per character.
MARGIN = 12.0
MARGIN_PER_CHAR = 0.4
#: Log-likelihood of a character once a value has left a kind's automaton.
OUTSIDE = -20.0
#: Characters of candidates that are scored in one go.
CELLS = 1 << 21
#: Confidence parameter of the Hoeffding bound.
ALPHA = 0.05

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
_NAMES = ("password", "passwd", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a shorter run fails as a whole, so it need not be matched
_CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{CANDIDATE_CHARS},}}")

# Character classes, and symbols that stand alone; the end of a value comes last.
_CLASSES = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]
_END = len(_CLASSES)
_SYMBOL = np.full(128, _END, dtype=np.int64)
for _i, _chars in enumerate(_CLASSES):
    for _c in _chars:
        _SYMBOL[ord(_c)] = _i

_SPAN = "struct<kind:string,start:long,end:long>"


def _rules(text: str) -> list[tuple[int, int, int, str]]:
    """start, kind's place, end and value of the rules' matches."""
    found = []
    lowered = text.lower()
    if any(name in lowered for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def _scan_text(text: str) -> tuple[list, list]:
    """The rules' matches, and the candidates (start, end) that none of them touches."""
    found = _rules(text)
    own = [(m.start(), m.end()) for m in _CANDIDATE.finditer(text)]
    if found and own:
        base = Spans((a, b) for a, _, b, _ in found)
        own = [(a, b) for a, b in own if not base.touch(a, b)]
    return found, own


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the rules' spans and values, and the candidates that no rule touches."""

    def run(columns):
        base, values, candidates = [], [], []
        for text in columns["text"]:
            text = text or ""
            found, own = _scan_text(text)
            base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b, _ in found])
            values.append([{"kind": KINDS[k], "value": v} for _, k, _, v in found])
            candidates.append([{"start": a, "end": b, "value": text[a:b]} for a, b in own])
        return {"doc_id": columns["doc_id"], "base": base, "vals": values, "candidates": candidates}

    schema = (
        f"doc_id long, base array<{_SPAN}>, vals array<struct<kind:string,value:string>>, "
        "candidates array<struct<start:long,end:long,value:string>>"
    )
    return map_batches(ids_and_texts(docs), run, schema)


class Automaton:
    """A prefix tree with counts, then the merged automaton."""

    def __init__(self, values: list[str]):
        self.next: list[dict[int, int]] = [{}]
        self.passed: list[dict[int, int]] = [{}]
        self.ended = [0]
        for value in values:
            state = 0
            for s in _SYMBOL[np.frombuffer(value.encode(), dtype=np.uint8)].tolist():
                self.passed[state][s] = self.passed[state].get(s, 0) + 1
                if s not in self.next[state]:
                    self.next[state][s] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                state = self.next[state][s]
            self.ended[state] += 1

    def _seen(self, state: int) -> int:
        return self.ended[state] + sum(self.passed[state].values())

    def _compatible(self, a: int, b: int, width: float) -> bool:
        """Whether b's tree could have come from state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self._seen(a), self._seen(b)
            bound = width * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if bound < 1:
                if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                    return False
                for s in self.passed[a].keys() | self.passed[b].keys():
                    if abs(self.passed[a].get(s, 0) / n - self.passed[b].get(s, 0) / m) > bound:
                        return False
            todo += [(self.next[a][s], c) for s, c in self.next[b].items() if s in self.next[a]]
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to state a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ended[a] += self.ended[b]
            for s, n in self.passed[b].items():
                self.passed[a][s] = self.passed[a].get(s, 0) + n
                if s in self.next[a]:
                    todo.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def merge(self, alpha: float = ALPHA) -> None:
        width = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        known = {0}
        while True:
            open_states = [(q, s) for q in settled for s in sorted(self.next[q]) if self.next[q][s] not in known]
            if not open_states:
                return
            q, s = max(open_states, key=lambda x: self.passed[x[0]][x[1]])  # the most travelled first
            new = self.next[q][s]
            for old in settled:
                if self._compatible(old, new, width):
                    self.next[q][s] = old
                    self._fold(old, new)
                    break
            else:
                settled.append(new)
                known.add(new)

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Next state and log-likelihood by state and symbol; the last state knows nothing."""
        number: dict[int, int] = {}
        todo = [0]
        while todo:
            q = todo.pop()
            if q not in number:
                number[q] = len(number)
                todo += sorted(self.next[q].values(), reverse=True)
        lost, n = len(number), _END + 1
        step = np.full((lost + 1, n), lost, dtype=np.int64)
        log = np.full((lost + 1, n), -math.log(n))
        for q, i in number.items():
            total = self._seen(q) + 0.1 * n
            log[i] = math.log(0.1 / total)
            for s, seen in self.passed[q].items():
                step[i, s] = number[self.next[q][s]]
                log[i, s] = math.log((seen + 0.1) / total)
            log[i, _END] = math.log((self.ended[q] + 0.1) / total)
        return step, log


def learn(scanned: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """An automaton for each kind, and one for ordinary tokens (kind ""), as small tables.

    Each learns from `sample` distinct values at most, those with the smallest hashes.
    """
    labelled = scanned.select(F.explode("vals").alias("v")).select("v.kind", "v.value")
    plain = scanned.select(F.lit("").alias("kind"), F.explode("candidates.value").alias("value"))
    each = []
    for kind in (*KINDS, ""):
        own = (labelled if kind else plain).where((F.col("kind") == kind) & (F.length("value") <= SAMPLE_CHARS))
        each.append(own.distinct().orderBy(F.xxhash64("value"), "value").limit(sample))
    chosen = each[0]
    for more in each[1:]:
        chosen = chosen.unionByName(more)

    def infer(rows: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton(sorted(rows["value"]))
        automaton.merge()
        step, log = automaton.table()
        return pd.DataFrame(
            {"kind": [rows["kind"].iloc[0]], "states": [len(step)], "step": [step.tobytes()], "log": [log.tobytes()]}
        )

    # a row for each kind; no automaton has more states than its sample has characters
    learned = chosen.groupBy("kind").applyInPandas(infer, "kind string, states long, step binary, log binary")
    return {
        r["kind"]: (
            np.frombuffer(r["step"], dtype=np.int64).reshape(r["states"], -1),
            np.frombuffer(r["log"], dtype=np.float64).reshape(r["states"], -1).copy(),
        )
        for r in learned.collect()
    }


def log_likelihoods(values: list[str], tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """One row for each value, one column for each automaton.

    Values are walked by length, a window of characters at a time and at most CELLS of them,
    however long the longest value is; shorter ones leave when they end.
    """
    out = np.zeros((len(values), len(tables)))
    lengths = np.array([len(v) for v in values])
    order = np.argsort(lengths, kind="stable")
    for rows in np.array_split(order, max(1, len(order) // 4096)):
        state, total = np.zeros((len(tables), len(rows)), dtype=np.int64), np.zeros((len(tables), len(rows)))
        at = done = 0
        while done < len(rows):
            own = rows[done:]
            width = min(max(1, CELLS // len(own)), int(lengths[own[-1]]) + 1 - at)
            symbols = np.full((len(own), width), -1, dtype=np.int64)
            for i, r in enumerate(own):
                piece = values[r][at : at + width].encode()
                symbols[i, : len(piece)] = _SYMBOL[np.frombuffer(piece, dtype=np.uint8)]
                if lengths[r] < at + width:
                    symbols[i, lengths[r] - at] = _END
            for (step, log), q, t in zip(tables, state[:, done:], total[:, done:]):
                for s in symbols.T:
                    live = s >= 0
                    t[live] += log[q[live], s[live]]
                    q[live] = step[q[live], s[live]]
            at += width
            done = int(np.searchsorted(lengths[rows], at))
        out[rows] = total.T
    return out


class Formats:
    """The learned automata as a judge of candidates."""

    def __init__(self, model: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.kinds = [k for k in KINDS if k in model and "" in model]
        self.tables = [model[k] for k in ("", *self.kinds)] if self.kinds else []
        for _, log in self.tables[1:]:
            log[-1] = OUTSIDE

    def kinds_of(self, values: list[str]) -> dict[str, str]:
        """The kind of every value that one explains far better than ordinary text."""
        distinct = list(dict.fromkeys(values))
        if not distinct or not self.kinds:
            return {}
        scores = log_likelihoods(distinct, self.tables)
        best = scores[:, 1:].argmax(axis=1)
        gain = scores[np.arange(len(distinct)), 1 + best] - scores[:, 0]
        return {
            v: f"like_{self.kinds[k]}"
            for v, k, g in zip(distinct, best.tolist(), gain.tolist())
            if g >= max(MARGIN, MARGIN_PER_CHAR * len(v))
        }


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, base and spans: the rules' spans, and all spans with those of the automata.

    Spans have kind, start and end (code points, end exclusive), by start and then kind.
    An added span's kind is that of its format after "like_". A null text counts as empty,
    repeated rows give repeated results; without labelled values nothing is added.
    """
    scanned = settle(scan(docs))
    formats = Formats(learn(scanned, sample))
    rank = dict(zip((*KINDS, *(f"like_{k}" for k in KINDS)), count()))

    def run(columns):
        kinds = formats.kinds_of([c["value"] for own in columns["candidates"] for c in own])
        spans = []
        for base, own in zip(columns["base"], columns["candidates"]):
            added = [
                {"kind": kinds[c["value"]], "start": c["start"], "end": c["end"]} for c in own if c["value"] in kinds
            ]
            spans.append(sorted([*base, *added], key=lambda s: (s["start"], rank[s["kind"]])))
        return {"doc_id": columns["doc_id"], "base": columns["base"], "spans": spans}

    schema = f"doc_id long, base array<{_SPAN}>, spans array<{_SPAN}>"
    return map_batches(scanned.select("doc_id", "base", "candidates"), run, schema)


def mask_secrets(docs: DataFrame, sample: int = SAMPLE, mark: str = "<secret>") -> DataFrame:
    """`docs` with all columns and rows, and in `text` the mark in place of every span that
    find_secrets gives (of overlapping ones, of all that they cover). A null text stays null."""
    formats = Formats(learn(settle(scan(docs).drop("base")), sample))

    def masked(texts):
        scanned = [_scan_text(t or "") for t in texts]
        kinds = formats.kinds_of([t[a:b] for t, (_, own) in zip(texts, scanned) for a, b in own])
        out = []
        for text, (found, own) in zip(texts, scanned):
            spans = [(a, b) for a, _, b, _ in found] + [(a, b) for a, b in own if text[a:b] in kinds]
            if spans:
                left = gaps(len(text), sorted(spans))
                edges = [0, *(e for gap in left for e in gap), len(text)]
                # between two gaps, before the first and after the last lies a covered stretch
                text = "".join(
                    text[edges[i] : edges[i + 1]] if i % 2 else mark if edges[i] < edges[i + 1] else ""
                    for i in range(len(edges) - 1)
                )
            out.append(text)
        return {"text": out}

    return rewrite(docs.withColumn("text", F.col("text").cast("string")), masked, ["text"], "text string")
