"""Byte-level BPE: encoding by a lazily determinised transducer, streaming decoding.

Encoder. A tokenisation is the BPE one exactly if each pair of neighbouring tokens
is what BPE makes of the two tokens' bytes. So each prefix of the input has one
tokenisation, and those of longer prefixes grow out of it. The transducer reads
bytes; its state is the set of open ends (a place in the vocabulary's trie where
a token may still grow, with the tokens before it that are not yet certain). What
all open ends agree on is emitted, so the lookahead is bounded by the longest
token. States and transitions are made when first met and then remembered.

Decoder. Token bytes pass a state machine that knows how many bytes the current
UTF-8 character still needs, so text can be emitted token by token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import Memo, no_cycles, slices


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


def merge_pairs(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> tuple[int, ...]:
    """BPE by its definition: join the lowest-ranked neighbours, leftmost first, as
    long as there are any that rank before ``below``."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return tuple(ranks[p] for p in parts)


class Transducer:
    """``encode(piece)`` gives the ids of one pre-split piece.

    ``most`` bounds the remembered states.
    """

    def __init__(self, ranks: dict[bytes, int], most: int = 250_000):
        self.ranks, self.most = ranks, most
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        self.sorted = [i for _, i in sorted(ranks.items())]
        self.first, self.count = [0], [0]  # the tokens that go on from a node are a range of the sorted ones
        for at, i in enumerate(self.sorted):
            node = 0
            for b in self.bytes_of[i]:
                if not self.count[node]:
                    self.first[node] = at
                self.count[node] += 1
                nxt = self.trie[node].get(b)
                if nxt is None:
                    nxt = self.trie[node][b] = len(self.trie)
                    self.trie.append({})
                    self.first.append(0)
                    self.count.append(0)
                node = nxt
            self.token_at[node] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}  # of each token its last merge; only tokens that merging makes
        for token, i in ranks.items():
            parts = merge_pairs(token, ranks, i)  # without the last merge
            if len(parts) == 2 or len(token) == 1:
                self.halves[i] = parts if len(parts) == 2 else None
        self.joined = {h: i for i, h in self.halves.items() if h}
        start = (-1, ((0, ()),))
        self.open: dict[tuple[int, int], bool] = {}
        self.index = {start: 0}
        self.states = [start]
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a (-1: at the start).

        Taking the two tokens apart from their last merge on shows the tokens that
        met at their border over time; a merge of two of these that ranks before
        the merge that ended their meeting would have come first, so a and b would
        never have stood side by side.
        """
        if a < 0:
            return b in self.halves
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[a, b] = b in self.halves and self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        halves, joined = self.halves, self.joined
        ended = (1 << 60, 0)  # rank of the merge that ended the meeting, and whether it was on the right
        while True:
            rank = joined.get((a, b))
            # merges of one rank go from left to right: the border's goes before one on its right
            if rank is not None and (rank < ended[0] or rank == ended[0] and ended[1]):
                return False
            left, right = halves[a], halves[b]
            if left is None and right is None:
                return True
            if right is None or left is not None and a > b:
                ended, a = (a, 0), left[1]
            else:
                ended, b = (b, 1), right[0]

    def can_grow(self, last: int, node: int) -> bool:
        """Whether a longer token from this node may follow token ``last`` (taken
        for granted where very many tokens go on). Ends that can't are dropped."""
        n = self.count[node]
        if last < 0 or n > 200:
            return True
        known = self.open.get((last, node))
        if known is None:
            if len(self.open) > 500_000:
                self.open.clear()
            at = self.first[node]
            known = self.open[last, node] = any(
                t in self.halves and self._apart(last, t) for t in self.sorted[at:at + n])
        return known

    def step(self, key: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        """From one set of open ends to the next, and what they now agree on."""
        last, ends = key
        after, closed = [], None
        for node, chain in ends:
            nxt = self.trie[node].get(byte)
            if nxt is None:
                continue
            token = self.token_at.get(nxt)
            if closed is None and token is not None and self.follows(chain[-1] if chain else last, token):
                closed = chain + (token,)
            if self.count[nxt] and self.can_grow(chain[-1] if chain else last, nxt):
                after.append((nxt, chain))
        if closed is None:
            raise ValueError(f"the vocabulary lacks byte {byte}")
        after.append((0, closed))
        if len(after) == 1:
            return (closed[-1], ((0, ()),)), closed
        chains = [c for _, c in after]
        low, high, shared = min(chains), max(chains), 0  # what these two share, all share
        for x, y in zip(low, high):
            if x != y:
                break
            shared += 1
        if not shared:
            return (last, tuple(after)), ()
        emitted = low[:shared]
        return (emitted[-1], tuple([(n, c[shared:]) for n, c in after])), emitted

    def encode(self, piece: bytes) -> list[int]:
        """Runs the remembered automaton; where it ends, states are made, or, once
        ``most`` exist, passed through without remembering them."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, key, out, moves, index = 0, None, [], self.moves, self.index
        for byte in piece:
            if key is None:
                found = moves[state].get(byte)
                if found is not None:
                    state, emitted = found
                    if emitted:
                        out += emitted
                    continue
                key = self.states[state]
                known = state
            else:
                known = -1
            key, emitted = self.step(key, byte)
            if emitted:
                out += emitted
            to = index.get(key)
            if to is None and len(index) < self.most:
                to = index[key] = len(index)
                self.states.append(key)
                moves.append({})
            if to is not None:
                if known >= 0:
                    moves[known][byte] = to, emitted
                state, key = to, None
        ends = (self.states[state] if key is None else key)[1]
        return out + list(ends[-1][1])  # the end that is closed here


class Encoder:
    """Ids of whole texts: each match of ``pattern`` is encoded separately.

    A space before a non-space always begins a match, so parts from there to the
    next such place are encoded apart, and remembered.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.pieces = regex.compile(pattern).findall
        self.blank_after_space = regex.compile(r" (?:\s|$)").search
        self.parts = regex.compile(r"(?: (?=\s|\z)|[^ ])+| (?!\s|\z)(?: (?=\s|\z)|[^ ])*").findall
        self.piece_ids = Memo(lambda p: array("i", self.transducer.encode(p.encode("utf-8", "replace"))).tobytes(), 24 << 20)
        self.part_ids = Memo(self._part, 48 << 20)

    def _part(self, part: str) -> bytes:
        pieces = self.pieces(part)
        return b"".join(map(self.piece_ids.getter(set(pieces)), pieces))

    def encode(self, text: str | None) -> bytes:
        """Native 32-bit ids (null and empty texts: none)."""
        if not text:
            return b""
        if self.blank_after_space(text):
            parts = self.parts(text)
        else:
            first, *rest = text.split(" ")
            parts = [first] if first else []
            parts += [" " + p for p in rest]
        return b"".join(map(self.part_ids.getter(set(parts)), parts))


class Utf8Stream:
    """Incremental UTF-8 decoding: ``feed`` takes any bytes and returns the text
    that is complete; ``close`` returns what is left, broken ends replaced by
    U+FFFD. ``valid`` tells whether all bytes so far were proper UTF-8."""

    def __init__(self):
        self.rest, self.valid = b"", True

    @staticmethod
    def needs(lead: int) -> int:
        """Bytes of a character by its first byte (others count as one)."""
        return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4 if lead < 0xF8 else 1

    def feed(self, data: bytes) -> str:
        data = self.rest + data
        cut = len(data)
        for back in range(1, min(3, cut) + 1):  # an unfinished character begins in the last three bytes
            lead = data[cut - back]
            if lead >= 0xC0:
                if self.needs(lead) > back:
                    cut -= back
                break
            if lead < 0x80:
                break
        self.rest = data[cut:]
        return self._text(data[:cut])

    def _text(self, data: bytes) -> str:
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            self.valid = False
            return data.decode("utf-8", "replace")

    def close(self) -> str:
        data, self.rest = self.rest, b""
        return self._text(data)


def decode_stream(ids: Iterable[int], bytes_of: dict[int, bytes], block: int = 1 << 16) -> Iterator[str]:
    """Text of a stream of ids, block by block of tokens."""
    stream, buffer = Utf8Stream(), []
    for i in ids:
        buffer.append(bytes_of[i])
        if len(buffer) >= block:
            yield stream.feed(b"".join(buffer))
            buffer = []
    yield stream.feed(b"".join(buffer))
    yield stream.close()


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int).

    ``ranks_path`` is read on each worker. Null and empty texts have no ids; ids of
    rows may be null or repeat; other columns are dropped. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(ranks_path, pattern)
        for part, texts in _parts(batches):
            with no_cycles():
                found = [of.encode(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found)], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id, text (null ids: empty; broken UTF-8
    is replaced, and ``valid`` is false). An id that the vocabulary lacks fails."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(ranks_path, "").transducer.bytes_of
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts, valid = [], []
                for ids in part.column(1):
                    stream = Utf8Stream()
                    texts.append(stream.feed(b"".join(map(of.__getitem__, ids.as_py() or ()))) + stream.close())
                    valid.append(stream.valid)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(valid)],
                                                 names=["doc_id", "text", "valid"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, text string, valid boolean")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass: doc_id, ids, decoded (text). The
    decoder sees nothing but the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(ranks_path, pattern)
        bytes_of = of.transducer.bytes_of
        for part, texts in _parts(batches):
            with no_cycles():
                found = [of.encode(t) for t in texts]
                back = ["".join(decode_stream(np.frombuffer(x, np.int32).tolist(), bytes_of)) for x in found]
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(found), pa.array(back, pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for batch in batches:
        lengths = [n or 0 for n in pa.compute.binary_length(batch.column(1)).to_pylist()]
        for a, b in slices(lengths, 1 << 22):
            part = batch.slice(a, b - a)
            yield part, part.column(1).to_pylist()


def _lists(found: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(found) + 1, np.int32)
    offsets[1:] = np.cumsum([len(x) // 4 for x in found])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), np.int32)))
