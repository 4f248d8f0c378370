"""Packing documents into sequences of a fixed length.

Pieces are packed by best fit with a fixed number of open sequences: a bitset over the
free space of the open ones gives the tightest that fits, and when none fits and no
further one may be opened, the fullest is closed. Each task packs one bucket of pieces;
what is in its open sequences at the end goes on to the next round, which has fewer
tasks, until one task closes the last ones.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evalsieve.llm.bpe import CHUNK_CHARS, WordMemory, byte_characters, vocabulary
from evalsieve.llm.common import chunks, ids_and_texts, map_batches
from evalsieve.scale import settle

#: Tokens of a sequence, sequences that a task has open, pieces that a task packs.
LENGTH = 4096
OPEN = 4096
TASK_PIECES = 32_768
#: Tasks whose open sequences one task of the next round takes over.
MERGED_TASKS = 16
#: The id that ends every document.
END_ID = 1


class OpenSequences:
    """Open sequences by free space; bit f of `bits` is set if one has f tokens free."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0
        self.closed: list[int] = []

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        own = held.pop()
        if not held:
            self.bits &= ~(1 << free)
        self.open -= 1
        return own

    def place(self, size: int) -> tuple[int, int]:
        """Number of the sequence that takes a piece, and the piece's offset in it."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            own = self._take(free)
        else:
            if self.open >= self.most:  # the fullest has the least free space
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            own, free = self.made, self.length
            self.made += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(own)
            self.bits |= 1 << left
            self.open += 1
        else:
            self.closed.append(own)
        return own, self.length - free


def _bytes_of_words(path: str):
    """Ids of words by the tokenizers library, as little-endian unsigned 32-bit numbers."""
    library = Tokenizer.from_file(path)
    special = vocabulary(path).special
    table = {b: c for b, c in enumerate(byte_characters())}

    def fill(words):
        for w in words:
            if w in special:
                ids = [special[w]]
            else:  # a word is one unit of the model: no need to split it again
                ids = [t.id for t in library.model.tokenize("".join([table[b] for b in w.encode()]))]
            yield np.array(ids, dtype="<u4").tobytes()

    return fill


@lru_cache(maxsize=2)
def _memory(path: str) -> WordMemory:
    return WordMemory(_bytes_of_words(path))


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID,
                 with_ids: bool = True) -> DataFrame:
    """Every document's ids, closed by `end_id` and cut into pieces of at most `length`.

    doc_id, piece, start, length, ids_crc32 and, unless left out, the ids themselves. A null
    text counts as empty and gives the end id alone. Repeated rows give repeated pieces.
    """

    def run(columns):
        texts = [t or "" for t in columns["text"]]
        vocab, memory = vocabulary(path), _memory(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
        for a, b in chunks(texts, CHUNK_CHARS):
            split = [vocab.words(t) for t in texts[a:b]]
            memory.update(set().union(*split))
            get = memory.known.__getitem__
            for doc_id, words in zip(columns["doc_id"][a:b], split):
                coded = b"".join(map(get, words)) + end
                for piece, at in enumerate(range(0, len(coded), 4 * length)):
                    own = coded[at : at + 4 * length]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(piece)
                    out["start"].append(at // 4)
                    out["length"].append(len(own) // 4)
                    out["ids_crc32"].append(zlib.crc32(own))
                    out["ids"].append(np.frombuffer(own, dtype="<u4").astype(np.int32) if with_ids else None)
        return out

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_batches(ids_and_texts(docs), run, schema + ", ids array<int>" * with_ids)


def pack(pieces: DataFrame, length: int = LENGTH, open_sequences: int = OPEN,
         task_pieces: int = TASK_PIECES) -> DataFrame:
    """`pieces` with sequence_id and offset; needs a column `length` from 1 to `length`.

    Pieces are dealt to tasks by a hash of all their columns and packed there from the longest
    down, by that hash among equal ones, so equal tables give equal sequences however they are partitioned. Equal
    rows are packed one by one. No piece is left out; an empty table gives an empty one.
    `pieces` is read twice: settle it if it is costly.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    plain = [c for c, kind in pieces.dtypes if not kind.startswith("map")]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in pieces.dtypes)
    schema += ", sequence_id long, offset long, _llm_order long, _llm_task long, _llm_open boolean"
    names = [*columns, "sequence_id", "offset"]
    left = pieces.withColumn("_llm_order", F.xxhash64(*plain))
    tasks = max(1, -(-pieces.count() // task_pieces))
    left = left.withColumn("_llm_task", F.pmod("_llm_order", F.lit(tasks)))
    done, number = [], 0
    while True:
        last = tasks == 1
        packed = settle(left.groupBy("_llm_task").applyInArrow(
            _packer(length, open_sequences, number, last), schema))
        done.append(packed.where(~F.col("_llm_open")).select(*names))
        if last:
            break
        tasks, number = -(-tasks // MERGED_TASKS), number + 1
        left = packed.where("_llm_open").drop("sequence_id", "offset", "_llm_open").withColumn(
            "_llm_task", F.floor(F.col("_llm_task") / MERGED_TASKS))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _packer(length: int, most: int, number: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        size = rows["length"].to_numpy()
        rows = rows.take(np.lexsort((rows["_llm_order"].to_numpy(), -size)))
        bins = OpenSequences(length, most)
        placed = np.array([bins.place(s) for s in rows["length"].to_pylist()], dtype=np.int64).reshape(-1, 2)
        closed = np.full(bins.made + 1, last)
        closed[bins.closed] = True
        base = (number << 56) + (rows["_llm_task"][0].as_py() << 24)
        made = {
            "sequence_id": placed[:, 0] + base,
            "offset": placed[:, 1],
            "_llm_order": rows["_llm_order"],
            "_llm_task": rows["_llm_task"],
            "_llm_open": ~closed[placed[:, 0]],
        }
        kept = rows.drop_columns(["_llm_order", "_llm_task"])
        for name, values in made.items():
            kept = kept.append_column(name, pa.array(values) if isinstance(values, np.ndarray) else values)
        return kept

    return run


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of the whole sequence, from packed pieces that carry `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
