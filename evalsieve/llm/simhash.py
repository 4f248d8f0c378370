"""Near-duplicate documents by SimHash, compared bit-sliced.

Candidates come in buckets. In a bucket the fingerprints are stored as bit planes, 64
fingerprints in a machine word; a query's plane differences are added to carry-save
counters, so 64 distances advance with a few bit operations, and a word in which every
counter has passed the radius is abandoned.

Small radii are searched exactly: fingerprints are cut into blocks, and any two within the
radius agree on all but `radius` of them, so every choice of the agreeing blocks is a
bucket. Wide radii, as a similarity of 0.8 needs, have no such cut; there the buckets are
bands of minimum hashes of the shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalsieve.llm.common import chunks, ids_and_texts, keyed, map_batches, parted_by_keys
from evalsieve.llm.components import components
from evalsieve.scale import settle

#: Words of a shingle, and the least similarity, unless a caller wants others.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: 64-bit words of the fingerprints that stand for that similarity.
WIDE_WORDS = 8
#: Bands of minimum hashes, and hashes in a band.
BANDS = 10
BAND_ROWS = 4
#: Fingerprints of a bucket that are compared in one go; larger buckets are cut up.
BUCKET = 1024

_SEED = 42
_CHUNK_CHARS = 1_000_000
#: Bytes of a shingle up to which it is hashed together with others.
_LONG = 256
_LANES = np.array(
    [sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64
)


def radius_for(similarity: float, bits: int) -> int:
    """Differing bits that two sets of a Jaccard similarity have on average, and a standard
    deviation more: SimHash measures the angle, and sets of equal size with
    similarity s have the cosine 2s / (1 + s)."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * p + np.sqrt(bits * p * (1 - p)))


#: Bytes with A-Z lowered and every blank of the word rule a space.
_PLAIN = bytes(32 if b in b"\t\n\v\f\r" else b for b in bytes(range(256)).lower())


def _words(text: str) -> bytes:
    """The words of a text, A-Z lowered, joined by one space."""
    plain = text.encode("utf-8").translate(_PLAIN).strip(b" ")
    return b" ".join(plain.split()) if b"  " in plain else plain


def _shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, one text after the other, and how many each has."""
    own = [_words(t) for t in texts]
    count = np.array([w.count(b" ") + 1 if w else 0 for w in own], dtype=np.int64)
    joined = b" ".join([w for w in own if w])
    blank = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts, ends = np.append(0, blank + 1), np.append(blank, len(joined))
    sizes = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    first = np.cumsum(count) - count - (np.cumsum(sizes) - sizes)
    at = np.arange(sizes.sum()) + np.repeat(first, sizes)
    last = at + np.repeat(np.minimum(count, words) - 1, sizes)
    return _xxh64(joined, starts[at], ends[last]), sizes


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    out = x << np.uint64(bits)
    out |= x >> np.uint64(64 - bits)
    return out


def _xxh64(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each stretch of the data, many at a time; `starts` ascend. Long ones go to the library."""
    out = np.zeros(len(starts), dtype=np.uint64)
    short = ends - starts <= _LONG
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], _SEED)
    own = np.flatnonzero(short)
    cuts = np.searchsorted(starts[own], np.arange(0, len(data) + _CHUNK_CHARS, _CHUNK_CHARS))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if a < b:
            part = own[a:b]
            base = int(starts[part[0]])
            piece = data[base : int(ends[part].max())]
            out[part] = _xxh64_short(piece, starts[part] - base, (ends - starts)[part])
    return out


def _xxh64_short(data: bytes, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    order = np.argsort(size.astype(np.int16), kind="stable")
    at, size = at[order], size[order]
    # the 64-bit word at every byte
    padded = data + bytes(8)
    word = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,)).astype(np.uint64)
    out = np.empty(len(at), dtype=np.uint64)
    sizes, cuts = np.unique(size, return_index=True)
    for n, a, b in zip(sizes.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        out[order[a:b]] = _xxh64_of_size(word, at[a:b], n)
    return out


def _xxh64_of_size(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """XXH64 of stretches of n bytes."""
    if n >= 32:
        sums = [np.full(len(at), (_SEED + p) % 2**64, dtype=np.uint64) for p in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
        for done in range(0, n - 31, 32):
            for k in range(4):
                sums[k] = _turned(sums[k] + word[at + (done + 8 * k)] * _P2, 31) * _P1
        h = _turned(sums[0], 1) + _turned(sums[1], 7) + _turned(sums[2], 12) + _turned(sums[3], 18)
        for v in sums:
            h = (h ^ (_turned(v * _P2, 31) * _P1)) * _P1 + _P4
        h += np.uint64(n)
    else:
        h = np.full(len(at), (_SEED + int(_P5) + n) % 2**64, dtype=np.uint64)
    done = n // 32 * 32
    while n - done >= 8:
        h = _turned(h ^ (_turned(word[at + done] * _P2, 31) * _P1), 27) * _P1 + _P4
        done += 8
    if done < n:
        rest = word[at + done]
        if n - done >= 4:
            h = _turned(h ^ ((rest & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            rest >>= np.uint64(32)
        for _ in range(n % 4):
            h = _turned(h ^ ((rest & np.uint64(255)) * _P5), 11) * _P1
            rest >>= np.uint64(8)
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64 bits of a hash."""
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Hashes that are added up as bit planes, to five of them.
_TILE = 31


def _tiled(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each hash stands in a table of _TILE rows, and the number of columns of each
    document, which begins in a column of its own."""
    tiles = -(-sizes // _TILE)
    place = np.arange(sizes.sum()) + np.repeat(_TILE * (np.cumsum(tiles) - tiles) - (np.cumsum(sizes) - sizes), sizes)
    return place % _TILE * tiles.sum() + place // _TILE, tiles


def _added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bit planes."""
    total, carry = a ^ b, a & b
    carry |= total & c
    total ^= c
    return total, carry


def _majority(h: np.ndarray, sizes: np.ndarray, place: np.ndarray, tiles: np.ndarray) -> np.ndarray:
    """Bits that are set in over half of the hashes of each document; all have some."""
    rows = np.zeros(_TILE * int(tiles.sum()), dtype=np.uint64)
    rows[place] = h
    planes, lanes = list(rows.reshape(_TILE, -1)), 0
    for weight in range(_TILE.bit_length()):
        carries = []
        left = planes[0]
        for b, c in zip(planes[1::2], planes[2::2]):
            left, carry = _added(left, b, c)
            carries.append(carry)
        lanes = lanes + (_LANES[left.view(np.uint8).reshape(-1, 8)] << np.uint64(weight))
        planes = carries
    # few columns of one document at a time, so that no 8-bit lane overflows
    most = 255 // _TILE
    starts = np.cumsum(tiles) - tiles
    cuts = np.concatenate([np.arange(a, a + n, most) for a, n in zip(starts.tolist(), tiles.tolist())])
    part = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(len(cuts), 64).astype(np.int64)
    runs = -(-tiles // most)
    count = np.add.reduceat(part, np.cumsum(runs) - runs, axis=0)
    return np.packbits(2 * count > sizes[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, width: int = WIDE_WORDS,
                 bands: int = BANDS) -> DataFrame:
    """doc_id, fp (`width` longs) and the band keys of every document.

    Shingles are `words` words of the text with A-Z lowered, repeats included; a shorter text
    is one shingle, and one without words, or a null one, has a fingerprint of zeros. The
    first long is the majority of the 64-bit hashes, the others of further bits of them.
    """
    multipliers = np.random.default_rng(_SEED).integers(1, 2**62, bands * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(columns):
        texts = [t or "" for t in columns["text"]]
        fps, keys = [], []
        for a, b in chunks(texts, _CHUNK_CHARS):
            flat, sizes = _shingles(texts[a:b], words)
            fp = np.zeros((b - a, width), dtype=np.uint64)
            key = np.zeros((b - a, bands), dtype=np.uint64)
            full = np.flatnonzero(sizes)
            if len(full):
                sizes = sizes[full]
                place, tiles = _tiled(sizes)
                for k in range(width):
                    fp[full, k] = _majority(_mixed(flat, k) if k else flat, sizes, place, tiles)
                starts = np.cumsum(sizes) - sizes
                for band in range(bands):
                    own = np.zeros(len(full), dtype=np.uint64)
                    for m in multipliers[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                        least = np.minimum.reduceat(flat * m, starts)
                        own = _mixed(own ^ least, band + 1)
                    key[full, band] = own
            fps += fp.view(np.int64).tolist()
            keys += key.view(np.int64).tolist()
        return {"doc_id": columns["doc_id"], "fp": fps, "bands": keys}

    return map_batches(ids_and_texts(docs), run, "doc_id long, fp array<long>, bands array<long>")


def _block_keys(fp, radius: int, blocks: int):
    """One key for each choice of the blocks that agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    word = fp[0]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(n).alias("table"), word.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def _band_keys(bands):
    return F.transform(bands, lambda key, n: F.struct(n.alias("table"), key.alias("bits")))


def links(nodes: DataFrame, keys, radius: int, bucket: int = BUCKET) -> DataFrame:
    """a, b: for the nodes (node, fp, ...) of each bucket, a forest that connects exactly
    those that fingerprints within the radius connect; never all pairs.

    Buckets above `bucket` fingerprints are cut into parts, and every two parts are compared
    as one group, so no link is lost and no group has more than twice `bucket` of them.
    """
    placed = settle(nodes.select("node", F.explode(keys).alias("key")))
    # settled, so that both sides of the join are dealt anew and Spark can split a hot bucket
    sizes = settle(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.col("n") / bucket).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    met = (
        placed.join(sizes, "key")
        .join(nodes.select("node", "fp"), "node")  # fingerprints of shared buckets only
        .withColumns({"_parts": parts, "_own": own})
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .groupBy("key", F.least("_own", "_other").alias("x"), F.greatest("_own", "_other").alias("y"))
        .agg(F.collect_list("node").alias("nodes"), F.flatten(F.collect_list("fp")).alias("fps"))
        .where(F.size("nodes") > 1)
        .select("nodes", "fps")
    )

    def run(columns):
        a, b = [], []
        most = max(1, 4096 * bucket // 64)
        todo, words = [], 0
        for members, flat in zip(columns["nodes"], columns["fps"]):
            todo.append((members, np.array(flat, dtype=np.int64).view(np.uint64).reshape(len(members), -1)))
            words += len(members) * -(-len(members) // 64)
            if words >= most:
                _forests(todo, radius, a, b)
                todo, words = [], 0
        if todo:
            _forests(todo, radius, a, b)
        return {"a": a, "b": b}

    return map_batches(met, run, "a long, b long")


def _forests(buckets: list, radius: int, a: list, b: list) -> None:
    for (members, _), (i, j) in zip(buckets, close_pairs([fps for _, fps in buckets], radius)):
        root = np.arange(len(members))
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        for k in np.flatnonzero(root != np.arange(len(members))).tolist():
            a.append(members[k])
            b.append(members[root[k]])


def close_pairs(buckets: list[np.ndarray], radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each bucket of fingerprints (rows of 64-bit words) the pairs i < j within the radius.

    Buckets follow each other without gaps, so small ones share a machine word.
    """
    sizes = np.array([len(f) for f in buckets])
    ends = np.cumsum(sizes)
    first = ends - sizes
    width = buckets[0].shape[1]
    padded = np.zeros((-(-int(ends[-1]) // 64) * 64, width), dtype=np.uint64)
    np.concatenate(buckets, out=padded[: ends[-1]])

    # a query meets the later members of its bucket: some of its own word, and further words
    query = np.delete(np.arange(ends[-1]), ends[sizes > 0] - 1)
    end = np.repeat(ends, np.maximum(sizes - 1, 0))
    next_ = (query + 1) // 64
    reach = -(-end // 64) - next_
    q = np.repeat(query, reach)
    w = np.arange(len(q)) - np.repeat(np.cumsum(reach) - reach - next_, reach)
    ones = np.uint64(2**64 - 1)
    valid = ones << np.maximum(q + 1 - 64 * w, 0).astype(np.uint64)
    valid &= ones >> np.maximum(64 * (w + 1) - np.repeat(end, reach), 0).astype(np.uint64)

    levels = max(1, int(radius).bit_length())
    counters = [np.zeros(len(q), dtype=np.uint64) for _ in range(levels)]
    over = np.zeros(len(q), dtype=np.uint64)
    for k in range(width):
        column = padded[:, k]
        for bit in range(64):
            bits = ((column >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8)
            plane = np.packbits(bits.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
            carry = plane[w] ^ np.where(bits[q], ones, np.uint64(0))
            for c in counters:  # add one bit to every counter
                carried = c & carry
                np.bitwise_xor(c, carry, out=c)
                carry = carried
            over |= carry
            if bit % 8 == 7:
                alive = (~(over | _above(counters, radius)) & valid) != 0
                if not alive.all():
                    q, w, over, valid = q[alive], w[alive], over[alive], valid[alive]
                    counters = [c[alive] for c in counters]
            if not len(q):
                break
    near = ~(over | _above(counters, radius)) & valid
    hit = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(q) else np.zeros((0, 64))
    at, offset = np.nonzero(hit)
    i, j = q[at], 64 * w[at] + offset
    group = np.searchsorted(ends, i, side="right")
    order = np.argsort(group, kind="stable")
    i, j, group = i[order], j[order], group[order]
    cuts = np.searchsorted(group, np.arange(1, len(buckets)))
    return [(x - s, y - s) for x, y, s in zip(np.split(i, cuts), np.split(j, cuts), first)]


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits whose counters exceed the radius."""
    more = np.zeros_like(counters[0])
    same = ~more
    for level in reversed(range(len(counters))):
        if radius >> level & 1:
            same = same & counters[level]
        else:
            more |= same & counters[level]
            same = same & ~counters[level]
    return more


def groups(docs: DataFrame, words: int = SHINGLE_WORDS, similarity: float | None = SIMILARITY,
           radius: int | None = None, blocks: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id of all that chains of links reach.

    With `radius`, 64-bit fingerprints within it are linked, all of them. Otherwise wide
    fingerprints are linked within the radius that stands for `similarity`, if they share a
    band of minimum hashes. Every row is returned; equal fingerprints are compared once,
    however many rows have them, and a wide one goes by its 64-bit hash. Rows without a doc_id take part; a group of only such rows
    has a null component_id. An empty table gives an empty one.
    """
    if radius is None:
        made = settle(fingerprints(docs, words))
        radius = radius_for(similarity, 64 * WIDE_WORDS)
        keys, node = _band_keys(F.col("bands")), F.xxhash64("fp")
    else:
        made = settle(fingerprints(docs, words, width=1, bands=0))
        keys, node = _block_keys(F.col("fp"), radius, blocks), F.col("fp")[0]
    distinct = settle(
        made.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("bands").alias("bands"))
        .withColumn("node", node)
    )
    found = components(links(distinct, keys, radius))
    linked = distinct.select("node", "doc_id").join(found, "node")
    # settled, so that both are dealt anew for the join and Spark can split a hot component
    least = settle(linked.groupBy("root").agg(F.min("doc_id").alias("_llm_least")))
    linked = linked.join(least, "root").select("node", F.struct("_llm_least").alias("_llm_group"))
    ids = distinct.join(linked, "node", "left").select(
        "fp",
        F.when(F.col("_llm_group").isNull(), F.col("doc_id"))
        .otherwise(F.col("_llm_group._llm_least")).alias("component_id"),
    )
    return made.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id")


def groups_of_texts(docs: DataFrame, **how) -> DataFrame:
    """_llm_text, group: of every text that `keyed` tells apart, settled."""
    found = groups(keyed(docs).select(F.col("_llm_text").alias("doc_id"), "text"), **how)
    return settle(found.select(F.col("doc_id").alias("_llm_text"), F.col("component_id").alias("group")).distinct())


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The first document of every group, by doc_id and then the hash of the text, with all its
    columns. A null doc_id ranks first; of rows with equal doc_id and text one stays."""
    own = ["_llm_id", "_llm_text"]
    place = F.struct(*own)
    rows = settle(keyed(docs).select(*own))
    named = settle(rows.join(groups_of_texts(docs, **how), "_llm_text"))
    first = settle(named.groupBy("group").agg(F.min(place).alias("first")))
    gone = settle(named.join(first, "group").where(place != F.col("first")).select(*own).distinct())
    # only rows that may go are shuffled with their texts
    may, others = parted_by_keys(keyed(docs), gone, own)
    left = others.unionByName(may.join(gone, own, "left_anti"))
    repeated = settle(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*own))
    if repeated.head(1):
        may, others = parted_by_keys(left, repeated, own)
        once = may.join(repeated, own, "left_semi").dropDuplicates(own)
        left = others.unionByName(may.join(repeated, own, "left_anti")).unionByName(once)
    return left.select(*docs.columns)
