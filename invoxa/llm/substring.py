"""Removal of long passages that occur in an earlier document.

A passage of ``length`` words is a window. Positions modulo a period p that form a
difference cover have, for any two places i and j, a shift d < p with i + d and
j + d both covered. So two equal windows share a covered anchor of
``length - p + 1`` words at the same distance from their starts: anchors hashed at
covered positions only find all long matches. Anchors that several documents share
are then extended to the windows that hold them, and only those are compared.

Documents are dealt into small batches by a hash. Batches say which anchors they
hold, each once, and hear which of them others hold as well; then the same with the
windows around those and the smallest document of each. So a passage that a third
of all documents share is one entry a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from invoxa.llm.common import byte_texts, mix, no_cycles, windows

#: Difference covers: period and positions.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9)}
LAST = np.iinfo(np.int64).max


class _Hashes(dict):
    """Hash of each word; forgotten when there are very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


class Batch:
    """The words of some documents as one row of hashes, and where each ends."""

    def __init__(self, ids: pa.Array, texts: list[bytes | None], hashes: _Hashes, length: int):
        self.words = [(t or b"").split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        with no_cycles():
            self.codes = np.concatenate([np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
                                         for w in self.words] or [np.empty(0, np.uint64)])
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.id = np.array([LAST if i is None else i for i in ids.to_pylist()], np.int64)
        self.length = length

    def hashes_of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of all runs of ``n`` words within one document."""
        h = mix(windows(self.codes, n))
        at = np.flatnonzero(self.doc[:len(h)] == self.doc[n - 1:]) if len(h) else np.empty(0, np.int64)
        return at, h[at]

    def anchors(self, period: int) -> tuple[np.ndarray, np.ndarray]:
        at, h = self.hashes_of(self.length - period + 1)
        covered = np.isin((at - self.starts[self.doc[at]]) % period, COVERS[period])
        return at[covered], h[covered]

    def candidates(self, period: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that hold a shared anchor."""
        at, h = self.anchors(period)
        several = _held_by_several(h, self.doc[at])
        hit = at[_among(h, shared) | _among(h, several)]
        holds = np.zeros(len(self.codes) + 1, np.int64)
        np.add.at(holds, np.maximum(hit - period + 1, 0), 1)  # a window holds the anchor from any of these starts
        np.add.at(holds, hit + 1, -1)
        start, window = self.hashes_of(self.length)
        some = np.cumsum(holds)[start] > 0
        return start[some], window[some]


def _among(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values occur in the ascending ``of``."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


def _held_by_several(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    keys, first, _ = _least(h, doc)
    _, last, _ = _least(h, -doc)
    return keys[first != -last]


def _least(h: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the least value of each, and each entry's place among them."""
    keys, at = np.unique(h, return_inverse=True)
    least = np.full(len(keys), LAST, np.int64)
    np.minimum.at(least, at, value)
    return keys, least, at


def _deal(keys: np.ndarray, batch: int, buckets: int, *more: np.ndarray) -> pa.Table:
    """Rows (bucket, batch, keys, values) of ascending keys, one a bucket."""
    to = (mix(keys) >> np.uint64(13)) % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(buckets + 1))
    some = np.flatnonzero(np.diff(cuts))
    spread = [x[order] for x in (keys, *more)]
    cut = [pa.array([x[cuts[b]:cuts[b + 1]].tobytes() for b in some], pa.binary()) for x in spread]
    return pa.table([pa.array(some, pa.int64()), pa.array(np.full(len(some), batch), pa.int64()),
                     cut[0], cut[1] if more else pa.nulls(len(some), pa.binary())],
                    names=["bucket", "batch", "keys", "low"])


DEALT = "bucket long, batch long, keys binary, low binary"


def _entries(part: pa.Table, at: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All keys of some rows, each one's row, and the rows' batches."""
    keys = [np.frombuffer(x, np.uint64) for x in part.column(at).to_pylist()]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    return np.concatenate(keys or [np.empty(0, np.uint64)]), owner, part.column(at - 1).to_pylist()


def _answer(keys: np.ndarray, owner: np.ndarray, batches: list[int]) -> pa.Table:
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(batches) + 1))
    some = [i for i in range(len(batches)) if cuts[i + 1] > cuts[i]]
    return pa.table({"batch": pa.array([batches[i] for i in some], pa.int64()),
                     "keys": pa.array([keys[order[cuts[i]:cuts[i + 1]]].tobytes() for i in some], pa.binary())})


def _told(part: pa.Table) -> np.ndarray:
    """The ascending keys that a batch was told."""
    keys = [np.frombuffer(x, np.uint64) for x in part.column(1).to_pylist()]
    return np.sort(np.concatenate(keys or [np.empty(0, np.uint64)]))


def remove_repeats(docs: DataFrame, length: int = 13, period: int = 7, per_batch: int = 500,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: row (all its columns), doc_id, n_words, n_removed,
    kept (the words that stay, joined by one space).

    A word (a run of other characters than ASCII white space) is removed if a window
    of ``length`` words that covers it also starts in a document with a smaller id;
    windows are those of the input. Null, empty and short texts lose nothing; null
    text counts as empty. Rows with one id, or repeated rows, are one document's and
    take nothing from each other; null ids come after all others and take nothing
    from each other either. The columns of the input may have any names.

    Windows are compared by 64-bit hashes, after a hash of their anchor. Each batch
    of about ``per_batch`` documents, and each bucket of hashes, is one task's
    group; their sizes do not follow the input's. The text is shuffled once.
    """
    if period not in COVERS or period > length:
        raise ValueError(f"period must be one of {sorted(COVERS)}, and at most length")
    n = docs.count()
    batches, buckets = max(1, -(-n // per_batch)), max(32, n // (2 * per_batch))
    number = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(batches))
    columns = docs.columns
    rows = docs.select(number.alias("batch"), F.col(id_col).cast("long").alias("doc_id"),
                       *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    text_at = columns.index(text_col) + 2

    def read(part: pa.Table) -> Batch:
        part = part.combine_chunks()
        texts = [t for c in part.column(text_at).chunks for t in byte_texts(c)]
        return Batch(part.column(1), texts, _hashes(), length)

    def first_keys(part: pa.Table) -> pa.Table:
        _, h = read(part).anchors(period)
        return _deal(np.unique(h), part.column(0)[0].as_py(), buckets)

    def shared_anchors(part: pa.Table) -> pa.Table:
        keys, owner, of = _entries(part, 2)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        hit = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        return _answer(keys[hit], owner[hit], of)

    def window_keys(key, part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return _deal(np.empty(0, np.uint64), 0, buckets, np.empty(0, np.int64))
        batch = read(part)
        at, h = batch.candidates(period, _told(told))
        keys, low, _ = _least(h, batch.id[batch.doc[at]])
        return _deal(keys, key[0].as_py(), buckets, low)

    def earlier_windows(part: pa.Table) -> pa.Table:
        keys, owner, of = _entries(part, 2)
        low = np.concatenate([np.frombuffer(x, np.int64) for x in part.column(3).to_pylist()] or [np.empty(0, np.int64)])
        _, least, at = _least(keys, low)
        later = least[at] < low
        return _answer(keys[later], owner[later], of)

    def remove(key, part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return to_arrow_schema(out_schema).empty_table()
        part = part.combine_chunks()
        batch = read(part)
        at, h = batch.hashes_of(length)
        keys, low, place = _least(h, batch.id[batch.doc[at]])
        gone = at[(low[place] < batch.id[batch.doc[at]]) | _among(h, _told(told))]
        cover = np.zeros(len(batch.codes) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + length, -1)
        covered = np.cumsum(cover)[:-1] > 0
        kept, counts = [], []
        for words, a, b in zip(batch.words, batch.starts, batch.ends):
            lost = covered[a:b]
            counts.append(int(lost.sum()))
            kept.append(b" ".join([w for w, x in zip(words, lost.tolist()) if not x] if counts[-1] else words).decode("utf-8", "replace"))
        return pa.table([part.column(1), pa.array([len(w) for w in batch.words], pa.int64()),
                         pa.array(counts, pa.int64()), pa.array(kept, pa.string()), *part.columns[2:]],
                        names=["doc_id", "n_words", "n_removed", "kept", *part.column_names[2:]])

    out_schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept string")
    out_schema = T.StructType(out_schema.fields + [f for f in rows.schema.fields if f.name not in ("batch", "doc_id")])

    anchors = rows.groupBy("batch").applyInArrow(first_keys, DEALT)
    told = anchors.groupBy("bucket").applyInArrow(shared_anchors, "batch long, keys binary")
    found = rows.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(window_keys, DEALT)
    later = found.groupBy("bucket").applyInArrow(earlier_windows, "batch long, keys binary")
    out = rows.groupBy("batch").cogroup(later.groupBy("batch")).applyInArrow(remove, out_schema)
    return out.select("doc_id", "n_words", "n_removed", "kept",
                      F.struct(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns))).alias("row"))


_SEEN: list[_Hashes] = []


def _hashes() -> _Hashes:
    """One table of word hashes for each Python worker."""
    if not _SEEN:
        _SEEN.append(_Hashes())
    return _SEEN[0]
