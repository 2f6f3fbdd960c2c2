"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared bit-sliced.

Two fingerprints that differ in at most ``radius`` bits agree in all but ``radius``
of ``BLOCKS`` equal blocks of bits. For each choice of the blocks that may differ,
the others are a key; fingerprints of one key lie next to each other in the bit
planes of a bucket. All lanes are then compared with the lane ``s`` places on, for
s = 1, 2, ... up to the longest run of one key: plane by plane, the differing bits
are added to carry-save counters of one bit per lane, and words of 64 lanes whose
distances all exceed the radius are abandoned. Fingerprints are distinct and the
differing blocks are short, so a run has at most 2 ** (64 * radius / BLOCKS) lanes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from invoxa.llm.common import byte_texts, mix, written

BLOCKS = 8
BITS = 64


def fingerprint(text: bytes | None, words: int = 3, block: int = 1 << 16) -> int:
    """SimHash of a UTF-8 text: a bit is set if over half of the shingles' hashes
    have it. A-Z are lower-cased; fewer words than ``words`` are one shingle; no
    word gives 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(parts)) - 1:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for a in range(0, n, block):
        h = np.array([digest(joined[s:e], 42) for s, e in zip(starts[a:a + block], ends[a:a + block])], ">u8")
        ones += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), text_hash for each row. No shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in byte_texts(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)],
                                             names=["doc_id", "fp", "text_hash"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, fp long, text_hash long")


def key_masks(radius: int) -> np.ndarray:
    """For each choice of ``radius`` blocks the bits of the others."""
    width = BITS // BLOCKS
    full = (1 << BITS) - 1
    return np.array([full & ~sum(((1 << width) - 1) << (width * b) for b in free)
                     for free in combinations(range(BLOCKS), radius)], np.uint64)


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b has bit b of each fingerprint, 64 lanes to a word."""
    lanes = -(-len(fps) // 64) * 64
    bits = np.zeros((lanes, BITS), np.uint8)
    bits[:len(fps)] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def ahead(words: np.ndarray, at: np.ndarray, s: int) -> np.ndarray:
    """Words ``at`` of the lanes ``s`` places on (words: ... x W, padded)."""
    q, r = at + s // 64, np.uint64(s % 64)
    low = words[..., q]
    return low if not r else (low >> r) | (words[..., q + 1] << (np.uint64(64) - r))


def close_lanes(fps: np.ndarray, runs: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of lanes of one run that differ in at most ``radius`` bits.

    ``runs`` numbers the run of each lane, ascending. All such pairs are returned.
    """
    n = len(fps)
    last = np.searchsorted(runs, runs, side="right")  # where each lane's run ends
    reach = last - np.arange(n) - 1
    pad = np.zeros((BITS, int(reach.max(initial=0)) // 64 + 2), np.uint64)
    plane = np.concatenate((planes(fps), pad), axis=1)
    counters = max(1, (radius + 1).bit_length())
    top = -(-n // 64)
    reach_of_word = np.zeros(top * 64, np.int64)
    reach_of_word[:n] = reach
    reach_of_word = reach_of_word.reshape(top, 64)
    most = reach_of_word.max(axis=1)
    left, right = [], []
    for s in range(1, int(reach.max(initial=0)) + 1):
        at = np.flatnonzero(most >= s)
        mates = np.packbits(reach_of_word[at] >= s, axis=1, bitorder="little").view("<u8")[:, 0]
        count = np.zeros((counters, len(at)), np.uint64)
        over = ~mates
        for b in range(0, BITS, step):
            for k in range(b, b + step):
                carry = plane[k, at] ^ ahead(plane[k], at, s)
                for c in range(counters):
                    count[c], carry = count[c] ^ carry, count[c] & carry
                over |= carry
            over |= exceeds(count, radius)
            alive = over != ~np.uint64(0)
            if not alive.all():
                at, count, over = at[alive], count[:, alive], over[alive]
                if not len(at):
                    break
        if len(at):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(hits)
            left.append(at[w] * 64 + lane)
            right.append(left[-1] + s)
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def exceeds(count: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose bit-sliced count is over ``radius``, from the top slice down."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], ~np.uint64(0))
    for c in range(len(count) - 1, -1, -1):
        if radius >> c & 1:
            same &= count[c]
        else:
            more |= same & count[c]
            same &= ~count[c]
    return more


def smallest_reachable(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 .. n-1 the smallest node that the links reach."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (before == root).all():
            break
    return root


def links(reps: DataFrame, radius: int, buckets: int) -> DataFrame:
    """Links (a, b), b < a as signed longs, that connect exactly what the pairs of
    distinct fingerprints (column ``fp``) at ``radius`` or fewer bits connect.

    Each bucket of keys gives a star for each group that it connects, not its pairs.
    """
    masks = key_masks(radius)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            table = np.repeat(np.arange(len(masks), dtype=np.uint64), len(fps))
            lanes = np.tile(fps, len(masks))
            keys = (lanes & masks[table]) * np.uint64(len(masks) * 2 + 1) + table
            to = (mix(mix(keys)) >> np.uint64(11)) % np.uint64(buckets)
            order = np.argsort(to, kind="stable")
            cuts = np.searchsorted(to[order], np.arange(buckets + 1))
            some = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int64()),
                 pa.array([lanes[order[cuts[x]:cuts[x + 1]]].tobytes() for x in some], pa.binary()),
                 pa.array([table[order[cuts[x]:cuts[x + 1]]].astype(np.uint8).tobytes() for x in some], pa.binary())],
                names=["bucket", "fps", "tables"])

    def compare(part: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64)
        table = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8)
        order = np.lexsort((fps, fps & masks[table], table))
        fps, table = fps[order], table[order]
        keys = fps & masks[table]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (table[1:] != table[:-1])))
        runs = np.cumsum(new) - 1
        shared = np.bincount(runs)[runs] > 1
        fps, runs = fps[shared], runs[shared]
        i, j = close_lanes(fps, runs, radius)
        nodes, of = np.unique(fps.view(np.int64), return_inverse=True)
        root = smallest_reachable(len(nodes), of[i], of[j])
        moved = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"a": pa.array(nodes[moved]), "b": pa.array(nodes[root[moved]])})

    dealt = reps.select("fp").mapInArrow(deal, "bucket long, fps binary, tables binary")
    return dealt.groupBy("bucket").applyInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node that the edges (a, b) reach) for each node.

    Alternates two steps, each of which hangs neighbours on a smaller one, until
    every node hangs on its root; both aggregate before they shuffle. Each round is
    written to the shared folder.
    """
    def hang(e: DataFrame, larger: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if larger:
            both = both.union(e.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if larger:
            moved = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # each neighbour and the node itself
            moved = both.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                                                                 F.struct(F.col("u").alias("a"), F.col("m").alias("b"))))
                                               .alias("e")).select("e.*")
        return moved.where("a <> b").distinct()

    edges = written(edges, "edges")
    while True:
        nxt = written(hang(hang(edges, True), False), "edges")
        done = nxt.groupBy("a").count().where("count > 1").isEmpty() and \
            nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        edges = nxt
        if done:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def grouped(docs: DataFrame, words: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, text_hash, root (the component's own fingerprint), component_id
    for each row."""
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    fps = written(fingerprints(docs, words, id_col, text_col), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    buckets = max(32, fps.count() // 8192)
    roots = components(links(reps, radius, buckets))
    named = reps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(written(named.join(lowest, "root"), "components"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed long), component_id (the
    smallest doc_id reachable over links of at most ``radius`` bits).

    Null, empty and wordless texts have fingerprint 0, linked like any other. Rows
    with a null id get their component's smallest id; a component of null ids
    only has a null one. Repeated rows each give a row. Other columns are dropped,
    whatever their names. ``radius`` may be 0 to 3.
    """
    return grouped(docs, words, radius, id_col, text_col).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """One row of ``docs`` (all columns) for each component of near-duplicates: the
    one with the smallest id (null last), then the smallest hash of its text."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    stay = grouped(docs, words, radius, id_col, text_col).groupBy("root").agg(first).select(
        F.col("first.doc_id").alias("stay_id"), F.col("first.text_hash").alias("stay_hash"))
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("row_id"),
                        F.xxhash64(text_col).alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("stay_id")) & (F.col("row_hash") == F.col("stay_hash"))
    once = Window.partitionBy("row_id", "row_hash").orderBy(F.lit(0))  # repeated rows
    return (whole.join(stay, same, "left_semi").withColumn("place", F.row_number().over(once))
            .where("place = 1").select("row.*"))
