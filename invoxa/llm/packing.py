"""Cost-balanced packing of tokenised documents into fixed-length sequences.

The cost of a piece of n tokens is estimated as ``linear * n + quadratic * n * n``
(dense layers, attention). Pieces go in descending order to the cheapest sequence
that still has room for them; a piece that fits nowhere is cut.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import Memo, byte_texts, no_cycles, slices

SCHEMA = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if
    printable in Latin-1, else the next free code point from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of a ``tokenizers`` file whose normaliser and splitter never join text
    across white space, so each white-space separated part is encoded once and
    remembered. A part that is a word of plain letters and closing punctuation is
    two pieces, each for the file's model as it is; any other part goes through the
    file's whole chain. Special tokens written in a text are ordinary text, unless
    ``special`` (the library's default) gives them their ids."""

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece, 40 << 20)
        self.parts = Memo(self._part, 64 << 20)

    def _piece(self, piece: str) -> bytes:
        as_bytes = piece if piece.isascii() else "".join(map(byte_letters().__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()

    def _part(self, part: bytes) -> bytes:
        text = part.decode("utf-8", "replace")
        word = text.rstrip(".,;:!?")
        if len(word) < 100 and word.isalpha() and max(word) < "\u0130":  # lower case is one letter for one, nothing to compose
            ids = self.pieces.one(word.lower())
            return ids + self.pieces.one(text[len(word):]) if len(text) > len(word) else ids
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none)."""
        words = [(t or b"").split() for t in texts]
        with no_cycles():
            get = self.parts.getter(set().union(*words))
            return [b"".join(map(get, w)) for w in words]


@lru_cache(2)
def tokenizer(path: str, special: bool = False) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path, special)


class Packer:
    """Packs (document, start, length) pieces, a bounded number at a time."""

    def __init__(self, capacity: int, linear: float, quadratic: float, pool: int):
        self.capacity, self.linear, self.quadratic, self.pool = capacity, linear, quadratic, pool
        self.held: list[tuple[int, int, int]] = []
        self.sequences = 0

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def add(self, doc: int, length: int) -> list[tuple[int, int, int, int, int]]:
        """Takes a document; returns placements (doc, start, length, sequence, offset).
        What fills a sequence alone is placed at once, the rest waits for the pool."""
        whole = length // self.capacity
        out = [(doc, k * self.capacity, self.capacity, self.sequences + k, 0) for k in range(whole)]
        self.sequences += whole
        if rest := length - whole * self.capacity:
            self.held.append((doc, whole * self.capacity, rest))
        return out

    def full(self) -> bool:
        return len(self.held) >= self.pool

    def flush(self, last: bool) -> list[tuple[int, int, int, int, int]]:
        """Packs what waits. All sequences come out full; what is left over waits
        on, unless ``last``, when one more sequence's worth of room takes it."""
        total = sum(p[2] for p in self.held)
        n = -(-total // self.capacity) if last else total // self.capacity
        if not n:
            return []
        cost, used = np.zeros(n), np.zeros(n, np.int64)
        queue = [(-length, doc, start) for doc, start, length in self.held]
        heapq.heapify(queue)
        out, self.held = [], []
        while queue:
            size, doc, start = heapq.heappop(queue)
            length = -size
            room = self.capacity - used
            fits = room >= length
            if fits.any():
                at = int(np.where(fits, cost, np.inf).argmin())
                part = length
            else:  # cut it: the roomiest sequence takes what it can
                at = int(room.argmax())
                part = int(room[at])
                if not part:
                    self.held.append((doc, start, length))
                    continue
                heapq.heappush(queue, (part - length, doc, start + part))
            out.append((doc, start, part, self.sequences + at, int(used[at])))
            used[at] += part
            cost[at] += self.cost(part)
        self.sequences += n
        return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, linear: float = 1.0,
         quadratic: float = 1 / 4096, pool: int = 2048, id_col: str = "doc_id", text_col: str = "text",
         special: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset.

    Each document's ids, then ``end_id``, lie in exactly one piece each. Every
    sequence holds ``capacity`` ids, but for less than ``capacity`` free places in
    all per input partition. Each partition packs its own documents, ``pool``
    remainders at a time, so neither a shuffle nor an unbounded group is needed
    and a lost task is repeated alone; sequence ids carry the partition number in
    their upper bits. Null and empty texts are the end id alone. Rows with null or
    repeated ids are documents of their own; other columns are dropped. ``special``
    gives special tokens written in a text their ids; else they are ordinary text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path, special)
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, linear, quadratic, pool)
        kept: dict[int, tuple[int | None, bytes, int, int]] = {}  # id, ids from a start on, that start, all ids

        def rows(placed) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([kept[d][0] for d, *_ in placed], pa.int64()),
                 pa.array([s for _, s, *_ in placed], pa.int64()),
                 pa.array([kept[d][1][4 * (s - kept[d][2]):4 * (s + n - kept[d][2])] for d, s, n, *_ in placed], pa.binary()),
                 pa.array([kept[d][3] for d, *_ in placed], pa.int64()),
                 pa.array([base + q for *_, q, _ in placed], pa.int64()),
                 pa.array([o for *_, o in placed], pa.int64())],
                names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def emit(placed) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(placed), 1024):
                yield rows(placed[a:a + 1024])

        serial = 0
        for batch in batches:
            texts = byte_texts(batch.column(1))
            doc_ids = batch.column(0).to_pylist()
            for a, b in slices([len(t or b"") for t in texts], 1 << 22):
                for doc_id, found in zip(doc_ids[a:b], encoder.encode(texts[a:b])):
                    total = len(found) // 4 + 1
                    kept[serial] = doc_id, found + end, 0, total
                    yield from emit(packer.add(serial, total))
                    done = total - total % capacity
                    kept[serial] = doc_id, kept[serial][1][4 * done:], done, total
                    serial += 1
                    if packer.full():
                        yield from emit(packer.flush(last=False))
                        waiting = {p[0] for p in packer.held}
                        kept = {d: x for d, x in kept.items() if d in waiting}
        yield from emit(packer.flush(last=True))

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows_in.mapInArrow(run, SCHEMA)
