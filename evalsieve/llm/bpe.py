"""Byte-pair encoding and decoding of whole documents.

The words of a batch of texts are encoded together: the symbols of all words that have
not been seen lie in one flat array, and every round merges, in each word, the pair of
the lowest rank. Ranks are found by binary search over the sorted keys of all pairs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from evalsieve.llm.common import chunks, ids_and_texts, map_batches

#: Words that a Python worker remembers; it then starts afresh.
KEPT_WORDS = 400_000
#: Characters of text whose words are encoded together.
CHUNK_CHARS = 4_000_000

# The kind of tokenizer file that is read here.
_NORMALIZERS = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"},
]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SUFFIX = "</w>"

# Characters for which splitting is done here: Latin up to U+017F, unchanged by NFC.
_PLAIN = 0x180


def _plain_pattern() -> re.Pattern:
    kinds = {c: unicodedata.category(chr(c))[0] for c in range(_PLAIN)}
    letters = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "L")
    numbers = "".join(re.escape(chr(c)) for c, k in kinds.items() if k == "N")
    blank = r"\x09-\x0d\x20\x85\xa0"
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+"
    )


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the others
    from U+0100 on in their order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Splitting into words, and numpy merges, of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (
            model.get("end_of_word_suffix") != _SUFFIX
            or spec["normalizer"].get("normalizers") != _NORMALIZERS
            or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": _SPLIT}
            or spec["decoder"] is not None
        ):
            raise ValueError(f"{path} is another kind of tokenizer")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self._pattern = _plain_pattern()
        self._odd = re.compile(f"[^\x00-{chr(_PLAIN - 1)}]")
        self._bytes = {c: b for b, c in enumerate(byte_characters())}

        chars = byte_characters()
        self._inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self._last = np.array([vocab[c + _SUFFIX] for c in chars], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self._size = len(self.names)
        keys = np.array([vocab[a] * self._size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self._keys = keys[order]
        self._ranks = order.astype(np.int64)  # a pair's rank is its place in the file
        self._merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)

    def words(self, text: str) -> list[str]:
        """Words in order; a special token's string is one of them."""
        if "<|" in text and self._special.search(text):
            out = []
            for i, part in enumerate(self._special.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self._odd.search(text):
            return self._pattern.findall(text.lower())
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self._bytes.__getitem__, word)).decode("utf-8") for word, _ in pieces]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of every word, by merge rounds over one flat array."""
        if not words:
            return []
        coded = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
        raw = np.frombuffer(b"".join(coded), dtype=np.uint8)
        symbols = self._inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self._last[raw[ends]]
        word = np.repeat(np.arange(len(words)), lengths)

        done_symbols, done_words = [], []
        none = np.int64(len(self._merged))
        while True:
            pair = symbols[:-1] * self._size + symbols[1:]
            at = np.minimum(np.searchsorted(self._keys, pair), len(self._keys) - 1)
            found = (self._keys[at] == pair) & (word[:-1] == word[1:])
            rank = np.full(len(symbols), none)
            rank[:-1][found] = self._ranks[at[found]]
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(best, sizes)
            active = best < none
            if not active.all():
                done_symbols.append(symbols[~active])
                done_words.append(word[~active])
                symbols, word, rank, best = symbols[active], word[active], rank[active], best[active]
            if not len(symbols):
                break
            merge = rank == best
            # of overlapping equal pairs (a a a) the left one goes first
            first = merge & ~np.r_[False, merge[:-1]]
            place = np.arange(len(merge))
            run = np.maximum.accumulate(np.where(first, place, 0))
            merge &= (place - run) % 2 == 0
            symbols[merge] = self._merged[best[merge]]
            keep = ~np.r_[False, merge[:-1]]
            symbols, word = symbols[keep], word[keep]

        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        bounds = np.searchsorted(word[order], np.arange(1, len(words)))
        return np.split(symbols[order], bounds)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordMemory:
    """What a worker keeps of each word; new words of a chunk are encoded together."""

    def __init__(self, fill, most: int = KEPT_WORDS):
        self.fill, self.most, self.known = fill, most, {}

    def update(self, words: set[str]) -> None:
        new = words.difference(self.known)
        if new and len(self.known) + len(new) > self.most:
            self.known.clear()
            new = words
        if new:
            new = sorted(new)
            self.known.update(zip(new, self.fill(new)))


@lru_cache(maxsize=2)
def _text_memory(path: str) -> WordMemory:
    """Of each word the ids in decimals and the tokens, each joined by a space."""
    vocab = vocabulary(path)

    def fill(words):
        plain = [w for w in words if w not in vocab.special]
        ids = dict(zip(plain, vocab.encode_words(plain)))
        for w in words:
            own = ids[w].tolist() if w in ids else [vocab.special[w]]
            yield " ".join(map(str, own)), " ".join([vocab.names[i] for i in own])

    return WordMemory(fill)


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimals joined by a space) and decoded text of every document.

    A null text counts as empty; an empty text has no ids and decodes to the empty text.
    Rows are handled one by one, so repeated rows give repeated results. The file at
    `path` must be readable on every executor.
    """

    def run(columns):
        texts = [t or "" for t in columns["text"]]
        vocab, memory = vocabulary(path), _text_memory(path)
        ids, decoded = [], []
        for a, b in chunks(texts, CHUNK_CHARS):
            split = [vocab.words(t) for t in texts[a:b]]
            memory.update(set().union(*split))
            known = memory.known
            for words in split:
                both = [known[w] for w in words]
                ids.append(" ".join([x for x, _ in both]))
                decoded.append(" ".join([x for _, x in both]))
        return {"doc_id": columns["doc_id"], "ids": ids, "decoded": decoded}

    return map_batches(ids_and_texts(docs), run, "doc_id long, ids string, decoded string")
