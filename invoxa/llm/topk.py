"""Exact top-k search by inner product on quantised vectors, with a bit-sliced index.

Each attribute's values in a block of rows, made non-negative, are bit slices: one
bitmap over the rows for each bit. A query's score is the sum of the slices, each
shifted by the bits set in the query's component; carry-save adders add them level
by level, three bitmaps of one weight to a sum and a carry. The result is the score
of all rows in slices. Going down from the most significant one, rows that are
surely among the best and rows still equal to the boundary are kept as bitmaps; the
places left go to the boundary rows with the smallest ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.vectors import is_query, k_best, matrix, usable

ALL = ~np.uint64(0)
LONG = (1 << 63) - 1


def bitmap(rows: np.ndarray) -> np.ndarray:
    """Words of 64 rows from booleans (... x n)."""
    short = -rows.shape[-1] % 64
    if short:
        rows = np.concatenate((rows, np.zeros((*rows.shape[:-1], short), bool)), axis=-1)
    return np.packbits(rows, axis=-1, bitorder="little").view("<u8")


class SlicedBlock:
    """Bit slices of a block of integer vectors; rows ascend by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.low = self.values.min(axis=0)
        lifted = (self.values - self.low).astype(np.uint64)
        self.bits = [int(x).bit_length() for x in lifted.max(axis=0)]
        self.slices = [bitmap(((lifted[:, d] >> np.arange(b, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(bool))
                       for d, b in enumerate(self.bits)]
        self.valid = bitmap(np.ones(len(ids), bool))

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of each row's score less a constant.

        A negative component takes the complement of its attribute's slices, so
        that all that is added is positive.
        """
        levels: dict[int, list[np.ndarray]] = {}
        for d in np.flatnonzero(query):
            if not self.bits[d]:
                continue
            size = int(query[d])
            slices = self.slices[d] if size > 0 else ~self.slices[d]
            size = abs(size)
            for k in range(size.bit_length()):
                if size >> k & 1:
                    for b in range(self.bits[d]):
                        levels.setdefault(b + k, []).append(slices[b])
        out, level = [], 0
        carried = np.empty((0, len(self.valid)), np.uint64)
        while level <= max(levels, default=-1) or len(carried):
            rows = np.stack(levels[level]) if level in levels else carried[:0]
            rows, carried = (np.concatenate((rows, carried)) if len(carried) else rows), []
            while len(rows) > 1:
                third = len(rows) // 3
                if third:
                    a, b, c = rows[:third], rows[third:2 * third], rows[2 * third:3 * third]
                    half = a ^ b
                    carried.append((a & b) | (c & half))
                    rows = np.concatenate((half ^ c, rows[3 * third:]))
                else:
                    carried.append(rows[:1] & rows[1:])
                    rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else np.zeros(len(self.valid), np.uint64))
            carried = np.concatenate(carried) if carried else np.empty((0, len(self.valid)), np.uint64)
            level += 1
        return out

    def best(self, query: np.ndarray, k: int, own: int) -> np.ndarray:
        """Rows of the ``k`` highest scores (fewer if there are fewer), not ``own``."""
        equal = self.valid & ~bitmap(self.ids == own)
        sure = np.zeros_like(equal)
        if int(np.bitwise_count(equal).sum()) > k:
            need = k
            for s in reversed(self.score_slices(query)):
                high = equal & s
                n = int(np.bitwise_count(high).sum())
                if n > need:
                    equal = high
                else:
                    sure |= high
                    equal = equal & ~s
                    need -= n
                    if not need:
                        break
        else:
            need = k
        found = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        ties = np.flatnonzero(np.unpackbits(equal.view(np.uint8), bitorder="little"))[:need]
        return np.concatenate((found, ties))


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(x * scale)


def search(vectors: DataFrame, k: int = 20, scale: float = 64.0, every: int = 20, block: int = 16384,
           chunk: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``
    the ``k`` rows with another id and the highest inner product of the components
    floor(``scale`` * x), ties to the smaller id.

    Vectors that are null, empty, or hold null or non-finite components, and rows
    with a null id, take no part; shorter vectors are filled with zeros. Repeated
    rows are candidates each; repeated equal queries are one. A score beyond the range
    of a long counts as that range's end. Other columns are dropped.

    Queries in chunks meet rows in blocks: one task's group is a block of about
    ``block`` rows with a chunk of about ``chunk`` queries, whatever the input.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("v"), zero=True))
    n, queries, dim = rows.agg(F.count("*"), F.count_if(is_query(every)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-queries // chunk))
    spread = F.xxhash64("vec_id", "v")
    right = rows.withColumns({"b": F.pmod(spread, F.lit(blocks)), "c": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))})
    left = rows.where(is_query(every)).distinct().withColumns(
        {"c": F.pmod(F.xxhash64("v", "vec_id"), F.lit(chunks)).cast("int"),
         "b": F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")), "of": spread})

    def scan(these: pa.Table, those: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        if these.num_rows and those.num_rows:
            x, q = (quantise(matrix(t.column("v"), dim), scale) for t in (those, these))
            large = np.abs(x).max() * max(np.abs(q).max(), 1) * max(dim, 1) >= 2.0 ** 62
            if large:  # beyond 64-bit sums: whole numbers of any size
                x, q = (np.array([[int(e) for e in r] for r in m.tolist()], object) for m in (x, q))
            else:
                x, q = x.astype(np.int64), q.astype(np.int64)
            ids = those.column("vec_id").to_numpy()
            index = None if large else SlicedBlock(ids, x)
            for own, of, query in zip(these.column("vec_id").to_pylist(), these.column("of").to_pylist(), q):
                if large:
                    scores = [max(-LONG - 1, min(LONG, s)) for s in x @ query]
                    some = [i for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if ids[i] != own][:k]
                    best, scores = ids[some], [scores[i] for i in some]
                else:
                    some = index.best(query, k, own)
                    best, scores = index.ids[some], (index.values[some] @ query).tolist()
                for column, values in zip(out, ([own] * len(best), [of] * len(best), best.tolist(), scores)):
                    column += values
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query_id", "of", "vec_id", "score"])

    found = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(
        scan, "query_id long, of long, vec_id long, score long")
    return k_best(found, k)
