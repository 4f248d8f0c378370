"""SentencePiece (merge type) encoding and decoding of whole documents.

A text's tokens are read off a table over its prefixes. The merges of a prefix end in one
certain last token, and two tokens stand side by side in a result exactly if merging their
joint text leaves these two. So the last token of a prefix is the one token that ends there,
as an automaton over all pieces reports, and is compatible with the last token of the prefix
before it. Every entry takes a few lookups; the ids are then recovered from the last entry
backwards. The work is linear in the text, whatever its words.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame

from evalsieve.llm.common import chunks, ids_and_texts, map_batches

#: Words, and pairs of tokens, that a Python worker remembers; it then starts afresh.
KEPT_WORDS = 400_000
KEPT_PAIRS = 1_000_000
#: Characters of the longest word that is remembered.
KEPT_CHARS = 64
#: Characters of text whose words are held at a time.
CHUNK_CHARS = 4_000_000

# How the library marks a space, an unknown piece and a byte that is no text.
SPACE = "▁"
UNKNOWN = " ⁇ "
BROKEN = "�"


class Pieces:
    """The pieces of one model, and the table over the prefixes of a word.

    Models of the merge type with byte fallback, no normalisation and a dummy prefix are
    read; others are refused.
    """

    def __init__(self, path: str):
        library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = library.vocab_size()
        names = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (
            library.is_byte(i) or library.is_control(i) or library.is_unknown(i))]
        self._bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self._byte_of = {i: b for b, i in enumerate(self._bytes)}
        self._names = names
        self._silent = {i for i in range(size) if library.is_control(i)}
        self._unknown = library.unk_id()
        self.ids = {names[i]: i for i in plain}
        #: When a pair may merge into this text: a smaller number goes first.
        self.turn = {names[i]: -library.get_score(i) for i in plain}
        longer = [p for p in self.ids if len(p) > 1]
        probe = "  ﬁ a ͸"
        if (
            len(self._byte_of) != 256 or self._unknown in self._byte_of
            or any(library.is_unused(i) for i in plain)
            or any(SPACE in p.lstrip(SPACE) for p in longer)
            or library.decode(library.encode(probe)) != probe
            or library.encode(probe) != library.encode(probe, enable_sampling=False)
        ):
            raise ValueError(f"{path} is another kind of model")
        # no token reaches across a space, nor across a character that no longer piece holds
        held = set("".join(longer))
        lone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in held and c != " ")
        self._words = re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        # spines of every piece that its own text merges into: the tokens at its left and
        # right end since the beginning, each with its turn and that of the next one
        self._left: dict[str, list[tuple[str, float, float]]] = {}
        self._right: dict[str, list[tuple[str, float, float]]] = {}
        automaton = ahocorasick.Automaton()
        for piece in sorted(self.ids, key=len):
            if len(piece) == 1 or self._grow(piece):
                automaton.add_word(piece, piece)
        automaton.make_automaton()
        self._automaton = automaton
        self._pairs: dict[tuple[str, str], bool] = {}

    def _grow(self, piece: str) -> bool:
        """Merge a piece's own text; note its spines if the piece comes out."""
        parts, turn, before = list(piece), self.turn, -math.inf
        left, right = [(piece[0], -math.inf)], [(piece[-1], -math.inf)]
        while len(parts) > 1:
            now, at = min((turn.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if now == math.inf:
                return False
            if now < before:
                raise ValueError(f"{piece!r} merges out of turn")
            before = now
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                left.append((parts[0], now))
            if at == len(parts) - 1:
                right.append((parts[-1], now))
        for spine, kept in ((left, self._left), (right, self._right)):
            ends = [now for _, now in spine[1:]] + [math.inf]
            kept[piece] = [(text, now, end) for (text, now), end in zip(spine, ends)]
        return True

    def _spine(self, spines: dict, token: str) -> list[tuple[str, float, float]]:
        return spines.get(token) or [(token, -math.inf, math.inf)]

    def compatible(self, a: str, b: str) -> bool:
        """Whether the merges of the joint text of two tokens leave just these two.

        They do unless, at some moment, the token then at the end of `a` may merge with the
        one then at the start of `b` before either is used up. Of equal turns the leftmost
        goes first: inside `a`, then across, then inside `b`.
        """
        known = self._pairs.get((a, b))
        if known is not None:
            return known
        ends, starts = self._spine(self._right, a), self._spine(self._left, b)
        i = j = 0
        fits = True
        while fits:
            x, _, x_end = ends[i]
            y, _, y_end = starts[j]
            across = self.turn.get(x + y, math.inf)
            fits = not (across < x_end and across <= y_end and across < math.inf)
            if x_end == y_end == math.inf:
                break
            if x_end <= y_end:
                i += 1
            else:
                j += 1
        if len(self._pairs) >= KEPT_PAIRS:
            self._pairs.clear()
        self._pairs[a, b] = fits
        return fits

    def tokens(self, word: str) -> list[str]:
        """The tokens of a text without its spaces."""
        last: list[str] = [""] * (len(word) + 1)  # the last token of each prefix
        known, compatible = self._pairs, self.compatible
        done = 0
        for at, token in self._automaton.iter(word):
            end = at + 1
            while done < at:  # a character in no piece stands alone
                done += 1
                if not last[done]:
                    last[done] = word[done - 1]
            if last[end]:
                continue
            start = end - len(token)
            if start:
                before = last[start]
                fits = known.get((before, token))
                if not (compatible(before, token) if fits is None else fits):
                    continue
            last[end] = token
        while done < len(word):
            done += 1
            if not last[done]:
                last[done] = word[done - 1]
        found, end = [], len(word)
        while end:
            found.append(last[end])
            end -= len(last[end])
        return found[::-1]

    def words(self, text: str) -> list[str]:
        return self._words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_word(self, word: str) -> list[int]:
        out = []
        for token in self.tokens(word):
            own = self.ids.get(token)
            out += [own] if own is not None else [self._bytes[b] for b in token.encode("utf-8")]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(text) for i in self.encode_word(word)]

    def raw(self, ids: list[int]) -> str:
        """The text of ids, the dummy prefix included."""
        out, waiting = [], bytearray()
        for i in [*ids, None]:
            if i in self._byte_of:
                waiting.append(self._byte_of[i])
                continue
            if waiting:
                out.append(_text_of(bytes(waiting)))
                waiting.clear()
            if i is None or i in self._silent:
                continue
            out.append(UNKNOWN if i == self._unknown else self._names[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.raw(ids)
        return text[1:] if ids and self._names[ids[0]].startswith(SPACE) else text


def _text_of(raw: bytes) -> str:
    """Bytes as text; each byte that is part of no character is a broken one."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[at : at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    pass
            else:
                size = 1
                out.append(BROKEN)
            at += size
        return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def _memory(path: str) -> dict[str, tuple[int, str, str]]:
    """Of each word that a worker remembers: number of ids, ids in decimals, decoded text."""
    return {}


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimals joined by commas) and decoded text of every document.

    A null text counts as empty; an empty text has no ids and decodes to the empty text.
    Rows are handled one by one, so repeated rows give repeated results, rows without a
    doc_id keep the null, and an empty table gives an empty one. Other columns, whatever
    their names, are not read. The model at `path` must be readable on every executor.
    """

    def run(columns):
        texts = [t or "" for t in columns["text"]]
        model, memory = pieces(path), _memory(path)
        counts, ids, decoded = [], [], []

        def coded(word):
            own = model.encode_word(word)
            return len(own), ",".join(map(str, own)), model.raw(own)

        for a, b in chunks(texts, CHUNK_CHARS):
            for text in texts[a:b]:
                parts = []
                for word in model.words(text):
                    part = memory.get(word)
                    if part is None:
                        part = coded(word)
                        if len(word) <= KEPT_CHARS:
                            if len(memory) >= KEPT_WORDS:
                                memory.clear()
                            memory[word] = part
                    parts.append(part)
                counts.append(sum([p[0] for p in parts]))
                ids.append(",".join([p[1] for p in parts]))
                decoded.append("".join([p[2] for p in parts]).removeprefix(" "))
        return {"doc_id": columns["doc_id"], "n_tokens": counts, "ids": ids, "decoded": decoded}

    return map_batches(ids_and_texts(docs), run, "doc_id long, n_tokens long, ids string, decoded string")
