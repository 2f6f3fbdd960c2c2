"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from invoxa.session import checkpoint_dir

#: Odd multipliers of the rolling polynomial and of the final mixer.
_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a ``local`` master may go without the setting; it then gets a scratch
    folder, since driver and executors are one process there.
    """
    base = checkpoint_dir(spark)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="invoxa-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder (a new path for each
    call) and read it back, so a lost executor never replays what came before."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Memo:
    """Remembers results of ``make`` for the keys used lately: two generations, so
    about twice ``most`` bytes at the utmost, and frequent keys never go."""

    def __init__(self, make, most: int = 32 << 20):
        self.make, self.most = make, most
        self.now, self.before, self.size = {}, {}, 0

    def getter(self, keys: set):
        """A function that gives the value of each of ``keys``."""
        if self.size > self.most:
            self.before, self.now, self.size = self.now, {}, 0
        now, before, make, size = self.now, self.before.get, self.make, 0
        for k in keys.difference(now):
            v = before(k)
            if v is None:
                v = make(k)
            now[k] = v
            size += len(k) + len(v) + 180
        self.size += size
        return now.__getitem__

    def one(self, key):
        v = self.now.get(key)
        if v is None:
            if self.size > self.most:
                self.before, self.now, self.size = self.now, {}, 0
            v = self.before.get(key)
            if v is None:
                v = self.make(key)
            self.now[key] = v
            self.size += len(key) + len(v) + 180
        return v


@contextmanager
def no_cycles():
    """Suspends the search for reference cycles: large tables of tuples make it
    slow, and the code within makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding to ``str``."""
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def slices(lengths: list[int], most: int, rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose lengths add up to at most ``most``
    (a longer single row is a range of its own)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += n
    if lengths:
        yield start, len(lengths)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (needed before taking a few of them)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def windows(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` consecutive 64-bit codes (unmixed)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    h = codes[:m].copy()
    for k in range(1, n):
        h *= _MULT
        h += codes[k:k + m]
    return h


def ngram_counts(docs: list[np.ndarray], sizes: tuple[int, ...], bits: int,
                 block: int = 1 << 20) -> np.ndarray:
    """Counts of hashed n-grams: one row of ``2 ** bits`` buckets per document.

    ``docs`` hold code points. Windows never cross documents. Longer documents
    than ``block`` are counted block by block, so temporary arrays stay small.
    """
    width = 1 << bits
    out = np.zeros((len(docs), width), np.float32)
    shift = np.uint64(64 - bits)
    for a, b in slices([len(d) for d in docs], block):
        if b - a == 1 and len(docs[a]) > block:
            long = docs[a]
            for n in sizes:
                for at in range(0, len(long), block):
                    part = long[at:at + block + n - 1].astype(np.uint64)
                    keys = mix(windows(part, n) * _MULT + np.uint64(n)) >> shift
                    out[a] += np.bincount(keys.astype(np.int64), minlength=width)
            continue
        lengths = np.array([len(d) for d in docs[a:b]], np.int64)
        codes = np.concatenate(docs[a:b]).astype(np.uint64)
        owner = np.repeat(np.arange(b - a, dtype=np.int64), lengths)
        total = np.zeros((b - a) * width, np.int64)
        for n in sizes:
            if len(codes) < n:
                continue
            keys = (mix(windows(codes, n) * _MULT + np.uint64(n)) >> shift).astype(np.int64)
            first, last = owner[:len(keys)], owner[n - 1:]
            whole = first == last
            total += np.bincount(first[whole] * width + keys[whole], minlength=(b - a) * width)
        out[a:b] = total.reshape(b - a, width)
    return out
