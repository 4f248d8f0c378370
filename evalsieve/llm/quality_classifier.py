"""A quality classifier: naive Bayes features for a support vector machine.

A text's features are the character and word n-grams that occur in it, hashed to a fixed
number, and how much of it repeats. Each is scaled by the log-ratio of its document counts
in the two classes, counted over all labelled training rows; a linear hinge-loss model is
then fitted by dual coordinate descent on a bounded sample of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm.common import ids_and_texts, map_batches, parted_by_keys, rewrite

#: Features are hashed to two to this power.
BITS = 17
#: Training documents of each class that the model is fitted on.
SAMPLE = 2048
EPOCHS = 20
#: Upper bound of the dual variables.
COST = 1.0

_SIZE = 1 << BITS
_SHIFT = np.uint32(32 - BITS)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, *range(9, 14)]] = True
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, dtype=np.uint64))
_SHARES = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)
_LAST = np.zeros(_SIZE, dtype=np.int64)


def _hashed(values: np.ndarray, salt: int) -> np.ndarray:
    """Integers to feature numbers, by multiplication."""
    mixed = values.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93 + 2 * salt)
    return ((mixed >> np.uint64(32)).astype(np.uint32) >> _SHIFT).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Distinct feature numbers of a text: 3 and 4 bytes in a row, words, pairs of words, and
    one for each share of 3-word runs that the repeated ones reach. None for an empty text."""
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    found = []
    wide = raw.astype(np.uint32)
    if len(raw) >= 3:
        three = wide[:-2] | wide[1:-1] << np.uint32(8) | wide[2:] << np.uint32(16)
        found.append(((three * np.uint32(0x9E3779B1)) >> _SHIFT).astype(np.int64))
        four = three[:-1] | wide[3:] << np.uint32(24)
        found.append(((four * np.uint32(0x85EBCA6B)) >> _SHIFT).astype(np.int64))
    inside = ~_BLANK[raw]
    starts = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if len(starts):
        letters = np.flatnonzero(inside)
        word = np.searchsorted(starts, letters, side="right") - 1
        place = (letters - starts[word]) & 63
        first = np.searchsorted(letters, starts)
        words = np.add.reduceat((raw[letters].astype(np.uint64) + np.uint64(1)) * _POWERS[place], first)
        pairs = words[:-1] * np.uint64(31) + words[1:]
        found += [_hashed(words, 1), _hashed(pairs, 2)]
        if len(pairs) > 1:
            runs = pairs[:-1] * np.uint64(31) + words[2:]
            share = 1 - len(np.unique(runs)) / len(runs)
            found.append(_hashed(np.flatnonzero(share >= np.array(_SHARES)) + 1, 3))
    if not found:
        return np.zeros(0, dtype=np.int64)
    every = np.concatenate(found)
    order = np.arange(len(every))
    _LAST[every] = order  # of equal numbers the last one stays
    return every[_LAST[every] == order]


def training_labels(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the rows to learn from: those not held out, labelled 0 or 1, once
    each; ids with both labels are left out."""
    return (
        labels.where(F.col("quality").isin(0, 1) & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("_other"))
        .where(F.col("quality") == F.col("_other"))
        .drop("_other")
    )


def held_out():
    """A third of the rows, by a checksum of the id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def log_ratios(docs: DataFrame, train: DataFrame) -> np.ndarray:
    """Of every feature the log-ratio of its share among good and among bad documents."""
    # labels grow with the documents, so they are never broadcast; of the texts only those are
    # shuffled that a bitmap of the labels' ids lets through
    may, _ = parted_by_keys(ids_and_texts(docs).where(~held_out()), train.select("doc_id"), ["doc_id"])
    labelled = may.join(train.hint("merge"), "doc_id")

    def count(batches):
        import pyarrow as pa

        seen = np.zeros((2, _SIZE), dtype=np.int64)
        docs_of = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label, features(text or "")] += 1
                docs_of[label] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_pydict(
            {
                "feature": np.r_[-1, some].astype(np.int64),  # -1: the documents
                "bad": np.r_[docs_of[0], seen[0, some]],
                "good": np.r_[docs_of[1], seen[1, some]],
            }
        )

    # one row a feature at most: bounded by the number of features
    rows = (
        labelled.select("text", F.col("quality").cast("int").alias("quality"))
        .mapInArrow(count, "feature long, bad long, good long")
        .groupBy("feature")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .toPandas()
    )
    total = rows[rows["feature"] < 0]
    rows = rows[rows["feature"] >= 0]
    out = np.zeros(_SIZE)
    if len(rows):
        good, bad = int(total["good"].iloc[0]), int(total["bad"].iloc[0])
        out[rows["feature"]] = np.log((rows["good"] + 1) / (good + 2)) - np.log((rows["bad"] + 1) / (bad + 2))
    return out


def descend(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray,
            epochs: int = EPOCHS, cost: float = COST) -> tuple[np.ndarray, float]:
    """Weights by feature (scaled by their ratios) and the bias, by dual coordinate descent.

    Every row is brought to unit length and has a constant entry for the bias.
    """
    values, squares = [], np.ones(len(rows))
    for k, own in enumerate(rows):
        x = ratios[own]
        norm = np.sqrt(x @ x)
        values.append(x / norm if norm > 0 else x)
        squares[k] += norm > 0
    sign = np.where(labels > 0, 1.0, -1.0)
    weights, bias, dual = np.zeros(_SIZE), 0.0, np.zeros(len(rows))
    draw = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for k in draw.permutation(len(rows)):
            own, x = rows[k], values[k]
            slope = sign[k] * (weights[own] @ x + bias) - 1
            new = min(max(dual[k] - slope / squares[k], 0.0), cost)
            step = new - dual[k]
            if step:
                weights[own] += step * sign[k] * x
                bias += step * sign[k]
                dual[k] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return weights, bias


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """Ratios, weights and bias, or None unless both classes have training rows."""
    train = training_labels(labels)
    drawn = [
        train.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        for q in (0, 1)
    ]
    # at most twice `sample` ids and labels
    chosen = ids_and_texts(docs).join(F.broadcast(drawn[0].unionByName(drawn[1])), "doc_id")
    ratios = log_ratios(docs, train)

    def own_features(columns):
        return {
            "doc_id": columns["doc_id"],
            "quality": columns["quality"],
            "features": [features(t or "").astype("<i4").tobytes() for t in columns["text"]],
        }

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "features"])
        labels = rows["quality"].to_numpy()
        if len(set(labels.tolist())) < 2:
            return pd.DataFrame({"weights": [], "bias": []})
        own = [np.frombuffer(f, dtype="<i4").astype(np.int64) for f in rows["features"]]
        weights, bias = descend(own, labels, ratios)
        return pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    featured = map_batches(
        chosen.select("doc_id", F.col("quality").cast("int").alias("quality"), "text"),
        own_features, "doc_id long, quality int, features binary",
    )
    # of rows that repeat a doc_id one counts, however many there are
    featured = featured.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("features").alias("features"))
    model = featured.groupBy().applyInPandas(solve, "weights binary, bias double").first()
    return None if model is None else (ratios, np.frombuffer(model["weights"]), model["bias"])


def _scores(texts: list, model) -> list[float]:
    """A null text counts as empty; without a model every score is 0.5."""
    if model is None:
        return [0.5] * len(texts)
    ratios, weights, bias = model
    squared, product = (ratios**2).astype(np.float32), (ratios * weights).astype(np.float32)
    out = []
    for text in texts:
        own = features(text or "")
        norm = float(np.sqrt(squared[own].sum(dtype=np.float64)))
        margin = bias + (float(product[own].sum(dtype=np.float64)) / norm if norm > 0 else 0.0)
        out.append(float(1 / (1 + np.exp(-4 * margin))))
    return out


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score, from 0 to 1, of every document. Rows are scored one by one."""
    return map_batches(
        ids_and_texts(docs),
        lambda columns: {"doc_id": columns["doc_id"], "score": _scores(columns["text"], model)},
        "doc_id long, score double",
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that are predicted good, with all their columns; texts are not shuffled."""
    model = fit(docs, labels, sample)
    scored = rewrite(docs, lambda texts: {"_llm_score": _scores(texts, model)}, ["text"], "_llm_score double")
    return scored.where(F.col("_llm_score") >= 0.5).drop("_llm_score")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learnt from the labels of the
    documents that are not held out."""
    scored = score(docs, fit(docs, labels, sample))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
