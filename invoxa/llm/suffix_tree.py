"""Language-model scores by a probabilistic suffix tree over words.

A state of the tree is a context of up to ``depth`` words. Its next-word distribution is
smoothed by that of the context without its first word, ``(n + prior * p) / (c + prior)``,
down to the smoothed word frequencies at the root. A context becomes a state if its suffix
is one and if it diverges: each of its occurrences, left out of the counts, is predicted by
it and by its suffix, and the summed log ratio must exceed ``divergence``. A word is scored
by the longest suffix of its history that is a state.

The corpus is cut into chunks of documents. A chunk asks for the corpus counts of its
distinct words and n-grams, each once: sorted keys travel as packed byte planes of their
differences, a range of keys at a time, and the totals come back in the same order. The
sums of the divergence test go the same way. So no task holds more than a chunk or a range
of keys, a word found everywhere is one key a chunk, and nothing is cut off or sampled.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import byte_texts, mix, no_cycles, shared_dir, slices, written

CHUNKS = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary"
ASKED = "part long, chunk long, keys binary, amounts binary"
TOLD = "part long, chunk long, told binary, distinct long, total long"
SCHEMA = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
          "score double, states long")

_MULT = np.uint64(0x9E3779B97F4A7C15)
#: Keys of the token after the last word and of the context before the first.
_END = xxhash.xxh64_intdigest(b"")
_START = xxhash.xxh64_intdigest(b" ")
#: Words have 64-bit keys, n-grams 48-bit ones: among 10^10 n-grams, 4 in 100,000 share
#: theirs with another and get its occurrences added.
_NGRAM_BITS = 48


def planes(values: np.ndarray) -> bytes:
    """Compressed: first all lowest bytes, then all second ones and so on, since the higher
    ones are mostly empty."""
    return zstandard.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), 1)


def from_planes(packed: bytes, kind) -> np.ndarray:
    raw, size = zstandard.decompress(packed), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).view(kind).ravel()


def chunk_rows(ids: list, held: list[bool], texts: list[bytes | None]) -> dict:
    """One chunk: its documents' tokens as indexes into its words, the frequent ones first."""
    index: dict[bytes, int] = {b"": 0}
    tokens, sizes = [], []
    for text in texts:
        words = (text or b"").lower().split()
        sizes.append(len(words) + 1)
        tokens += [index.setdefault(w, len(index)) for w in words]
        tokens.append(0)
    at = np.array(tokens, np.uint32)
    order = np.argsort(-np.bincount(at, minlength=len(index)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    keys = np.array([xxhash.xxh64_intdigest(w) for w in index], np.uint64)[order]
    return {"chunk": uuid.uuid4().int >> 65, "ids": ids, "held": held, "sizes": sizes,
            "tokens": planes(rank[at]), "words": keys.tobytes()}


class Chunk:
    """A chunk's tokens and, by level (words of context), their distinct event keys."""

    def __init__(self, row: dict, depth: int):
        self.id, self.ids, self.held, self.sizes = row["chunk"], row["ids"], row["held"], np.array(row["sizes"], np.int64)
        words = np.frombuffer(row["words"], np.uint64)[from_planes(row["tokens"], np.uint32)]
        self.doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.train = ~np.array(self.held, bool)[self.doc]
        self.end = words == np.uint64(_END)
        # Event key of a level: the context's key (the event before it, a level lower) and the word.
        self.context, self.where, self.keys, self.at = [None], [], [], []
        key = words
        for level in range(depth + 1):
            if level:
                context = np.concatenate([[np.uint64(_START)], key[:-1]])
                if level == 1:
                    context[self.place == 0] = np.uint64(_START)
                self.context.append(context)
                key = mix(mix(context * _MULT + words)) >> np.uint64(64 - _NGRAM_BITS)
            self.where.append(self.place >= level - 1)
            distinct, at = np.unique(key[self.where[-1]], return_inverse=True)
            self.keys.append(distinct)
            self.at.append(at.astype(np.int32))

    def spread(self, level: int, values: np.ndarray) -> np.ndarray:
        """Values of the distinct events of a level, token by token (0 where there is none)."""
        out = np.zeros(len(self.place), values.dtype)
        out[self.where[level]] = values[self.at[level]]
        return out

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.at[level], weights=self.train[self.where[level]], minlength=len(self.keys[level])).astype(np.uint32)


def ranges(keys: np.ndarray, bits: int, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted keys dealt over equal ranges of their values."""
    part = (keys >> np.uint64(bits - 32)) * np.uint64(parts) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1))) if len(part) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(part))
    return zip(part[starts].tolist(), starts.tolist(), ends.tolist())


def bits_of(level: int) -> int:
    return _NGRAM_BITS if level else 64


def ask(chunk: int, level: int, keys: np.ndarray, amounts: np.ndarray, parts: int) -> list[tuple]:
    out = []
    for part, x, y in ranges(keys, bits_of(level), parts):
        steps = np.diff(keys[x:y], prepend=np.uint64(0))
        out.append((level * parts + part, chunk, planes(steps), planes(amounts[x:y])))
    return out


def batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def answers(asked: DataFrame, kind, threshold: float | None = None) -> DataFrame:
    """Sums of each key's amounts over all chunks, told to every chunk that asked; or with a
    ``threshold`` whether the sum exceeds it. A row without chunk has a part's numbers."""

    def work(rows: pa.Table) -> pa.Table:
        keys = [np.cumsum(from_planes(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]
        amounts = [from_planes(a, kind) for a in rows["amounts"].to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(amounts), minlength=len(distinct))
        told = total.astype(np.uint64) if threshold is None else (total > threshold).astype(np.uint8)
        part, out, x = rows["part"][0].as_py(), [], 0
        for chunk, k in zip(rows["chunk"].to_pylist(), keys):
            out.append((part, chunk, planes(told[at[x:x + len(k)]]), None, None))
            x += len(k)
        out.append((part, None, None, int((total > 0).sum()), int(total.sum())))
        return pa.Table.from_batches([batch(out, TOLD)])

    return asked.groupBy("part").applyInArrow(work, TOLD)


def heard(rows: pa.Table, first: int, parts: int, kind) -> np.ndarray:
    """What a chunk was told for the keys of a level, in their order."""
    got = sorted((p, t) for p, t in zip(rows["part"].to_pylist(), rows["told"].to_pylist()) if first <= p < first + parts)
    return np.concatenate([from_planes(t, kind) for _, t in got]) if got else np.empty(0, kind)


class Model:
    """Counts that hold for a chunk's tokens, and the distributions they give."""

    def __init__(self, chunk: Chunk, totals: list[np.ndarray], size: int, vocabulary: int, prior: float, add: float = 0.1):
        self.n = [chunk.spread(k, t).astype(np.float64) for k, t in enumerate(totals)]
        self.size, self.vocabulary, self.prior, self.add = size, vocabulary, prior, add
        # Occurrences of a token's context: of the event that ends with it.
        ends = self.n[0][chunk.end][:1]
        self.c = [None]
        for level in range(1, len(totals)):
            c = np.concatenate([[0.0], self.n[level - 1][:-1]])
            if level == 1:
                c[chunk.place == 0] = ends
            self.c.append(np.where(chunk.where[level], c, 0.0))

    def logs(self, less: np.ndarray | float = 0.0) -> list[np.ndarray]:
        """Natural logarithm of each token's probability by level, ``less`` of its own
        occurrences left out."""
        p = (np.maximum(self.n[0] - less, 0) + self.add) / (self.size - less + self.add * (self.vocabulary + 1))
        out = [np.log(p)]
        for n, c in zip(self.n[1:], self.c[1:]):
            p = (np.maximum(n - less, 0) + self.prior * p) / (np.maximum(c - less, 0) + self.prior)
            out.append(np.log(p))
        return out


def score(docs: DataFrame, held_out: Column | None = None, depth: int = 2, prior: float = 100.0, least: int = 4,
          divergence: float = 2.0, chunk_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every row by a tree learnt from the rows where ``held_out`` (a condition) is
    false: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, root only),
    score (log10), states (tokens scored by a state other than the root).

    Tokens are the lower-cased (A-Z) parts between ASCII white space, then one end. A null or
    empty text is its end alone; repeated rows count and are scored row by row; a null id or a
    null condition counts as not held out; other columns are left out; an empty table gives no
    row. ``least`` occurrences are asked of a context before its divergence is tested.
    """
    spark = docs.sparkSession

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for b in batches:
            ids, out, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2))
            for x, y in slices([len(t or b"") for t in texts], chunk_bytes):
                with no_cycles():
                    row = chunk_rows(ids[x:y], out[x:y], texts[x:y])
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds)], names=list(row))

    condition = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    chunks = by_chunk(docs.select(F.col(id_col).cast("long").alias("doc_id"), condition.alias("held"), F.col(text_col).alias("text"))
                      .mapInArrow(cut, CHUNKS))
    tokens = chunks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (2 << 20)))

    def events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                chunk = Chunk(row, depth)
                for level in range(depth + 1):
                    yield batch(ask(chunk.id, level, chunk.keys[level], chunk.counts(level), parts), ASKED)

    told = written(answers(chunks.mapInArrow(events, ASKED), np.uint32), "totals")
    vocabulary, size = told.where(F.col("chunk").isNull() & (F.col("part") < parts)).agg(
        F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    def learnt(row: pa.Table, told: pa.Table) -> tuple[Chunk, Model, list]:
        chunk = Chunk(row.to_pylist()[0], depth)
        totals = [heard(told, level * parts, parts, np.uint64) for level in range(depth + 1)]
        model = Model(chunk, totals, size, vocabulary, prior)
        contexts = [None]
        for level in range(1, depth + 1):
            tested = model.c[level] >= least
            contexts.append((tested, *np.unique(chunk.context[level][tested], return_inverse=True)))
        return chunk, model, contexts

    def divergences(row: pa.Table, told: pa.Table) -> pa.Table:
        chunk, model, contexts = learnt(row, told)
        logs, out = model.logs(less=chunk.train.astype(np.float64)), []
        for level in range(1, depth + 1):
            tested, keys, at = contexts[level]
            gain = np.where(chunk.train, logs[level] - logs[level - 1], 0.0)[tested]
            sums = np.bincount(at, weights=gain, minlength=len(keys)).astype(np.float32)
            # A context's key is that of the event of the level below.
            out += [(p + (depth + 1) * parts, *r) for p, *r in ask(chunk.id, level - 1, keys, sums, parts)]
        return pa.Table.from_batches([batch(out, ASKED)])

    def scores(row: pa.Table, told: pa.Table) -> pa.Table:
        chunk, model, contexts = learnt(row, told)
        logs = model.logs()
        best, state = logs[0].copy(), np.ones(len(logs[0]), bool)
        deeper = np.zeros(len(state), np.int64)
        for level in range(1, depth + 1):
            tested, _, at = contexts[level]
            kept = heard(told, (depth + level) * parts, parts, np.uint8).astype(bool)
            is_state = np.zeros(len(state), bool)
            is_state[tested] = kept[at]
            state &= is_state
            best[state] = logs[level][state]
            deeper[state] = level
        n, total = len(chunk.ids), lambda v: np.bincount(chunk.doc, weights=v, minlength=n)
        ten = math.log(10)
        return pa.table([pa.array(chunk.ids, pa.int64()), pa.array(chunk.held, pa.bool_()), pa.array(chunk.sizes, pa.int64()),
                         pa.array(total(model.n[0] > 0).astype(np.int64)), pa.array(np.full(n, size, np.int64)),
                         pa.array(total(logs[0]) / ten), pa.array(total(best) / ten),
                         pa.array(total(deeper > 0).astype(np.int64))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    def asker(rows: DataFrame) -> DataFrame:
        return rows.where(F.col("chunk").isNotNull()).select("part", F.col("chunk").alias("asker"), "told").groupBy("asker")

    gains = chunks.groupBy("chunk").cogroup(asker(told)).applyInArrow(divergences, ASKED)
    kept = written(answers(gains, np.float32, divergence), "states")
    return chunks.groupBy("chunk").cogroup(asker(told.unionByName(kept))).applyInArrow(scores, SCHEMA)


def by_chunk(rows: DataFrame) -> DataFrame:
    """Written to the shared folder in buckets of ``chunk``, so later steps read it in place."""
    spark = rows.sparkSession
    name = f"chunks_{uuid.uuid4().hex}"
    (rows.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").option("compression", "zstd")
     .option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name))
    return spark.table(name)


def held_out_tenth(id_col: str = "doc_id"):
    """Documents whose id's checksum is divisible by 10."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 10 == 0
