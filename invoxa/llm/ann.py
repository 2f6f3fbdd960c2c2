"""Approximate nearest neighbours by inner product: inverted lists and an adaptive
dimension scan.

Vectors lie in the list of their nearest centroid; a query looks through its nearest
lists. There, vectors are turned by one random rotation. If the first columns hold a
share f of the query's squared length, they hold f * s of an inner product s on average:
a candidate's part along the query is split as the query is, its part across the query
at random, with a spread that follows from the norms. A candidate whose first columns
give less than f times the query's bound by more than ``sigmas`` such spreads is
abandoned. Those that reach the last column are scored on the original vectors in
double precision.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import written
from invoxa.llm.vectors import best_of, is_query, k_best, matrix, usable


@dataclass
class Index:
    """What every task needs; its size is bounded by the number of lists."""

    dim: int
    rotation: np.ndarray
    centroids: np.ndarray
    sample: np.ndarray  # rows whose k-th best is a bound from below for any query
    sample_ids: np.ndarray
    probes: int = 0


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of ``q`` with rows, summed from the first component on."""
    return np.cumsum(x * q, axis=1)[:, -1] if x.size else np.zeros(len(x))


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lists_of(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means centroids; starts from evenly spaced rows."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    c = unit[np.linspace(0, len(unit) - 1, min(lists, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-300), c)
    return c


def bounds(index: Index, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Per query its k-th best score among the sample's other rows (or -inf)."""
    if len(index.sample) <= k:
        return np.full(len(q), -np.inf)
    s = q @ index.sample.T
    s[index.sample_ids[None, :] == own[:, None]] = -np.inf
    return np.partition(s, len(index.sample) - k, axis=1)[:, len(index.sample) - k]


def scan(index: Index, q: np.ndarray, own: np.ndarray, low: np.ndarray, home: bool, x: np.ndarray, ids: np.ndarray, k: int,
         sigmas: float, columns: int, rows: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per query (ids, scores) of its ``k`` best among ``x`` that reach ``low``: some may
    be missed, with the probability of the test. Where ``home``, at least ``k`` are scored,
    the best by the first columns, and all of them count, so that no query ends up with
    fewer than there are."""
    qr, xr = q @ index.rotation, x @ index.rotation
    norm_q, norm_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    slack = 1e-9 * (1 + np.abs(low, where=np.isfinite(low), out=np.zeros_like(low)))
    slack += 1e-13 * norm_q * norm_x.max(initial=0)
    out = []
    dim = index.dim
    for a in range(0, len(q), rows):
        part, least, size = qr[a:a + rows], low[a:a + rows], norm_q[a:a + rows]
        share = np.minimum(np.cumsum(part ** 2, axis=1) / np.maximum(size ** 2, 1e-300)[:, None], 1)
        along = np.maximum(np.where(np.isfinite(least), least, 0), 0) ** 2  # of (norm_q * norm_x) ** 2
        i = j = got = None
        for at in range(0, dim, columns):
            to = min(at + columns, dim)
            f = share[:, to - 1] if to < dim else np.ones(len(part))
            spread = sigmas * np.sqrt(f * (1 - f) / max(dim - 1, 1))
            floor = least * f - slack[a:a + rows]
            if i is None:  # all pairs, as long as many are left
                got = part[:, at:to] @ xr[:, at:to].T if got is None else got + part[:, at:to] @ xr[:, at:to].T
                first_scores = got if at == 0 else first_scores
                across = np.sqrt(np.maximum(np.outer(size ** 2, norm_x ** 2) - along[:, None], 0))
                stay = got + spread[:, None] * across >= floor[:, None]
                if to == dim or np.count_nonzero(stay) * 16 < stay.size:
                    i, j = np.nonzero(stay)
                    got = got[i, j]
            else:
                got = got + np.einsum("nc,nc->n", part[i, at:to], xr[j, at:to])
                across = np.sqrt(np.maximum(size[i] ** 2 * norm_x[j] ** 2 - along[i], 0))
                stay = got + spread[i] * across >= floor[i]
                i, j, got = i[stay], j[stay], got[stay]
        cuts = np.searchsorted(i, np.arange(len(part) + 1))
        for n in range(len(part)):
            cand = j[cuts[n]:cuts[n + 1]]
            if home and len(cand) <= k:
                first = np.where(ids == own[a + n], -np.inf, first_scores[n])
                cand = np.union1d(cand, np.argpartition(-first, min(k, len(first) - 1))[:k])
            cand = cand[ids[cand] != own[a + n]]
            scores = exact(q[a + n], x[cand])
            if not home:
                cand, scores = cand[scores >= low[a + n]], scores[scores >= low[a + n]]
            order = np.lexsort((ids[cand], -scores))[:k]
            out.append((ids[cand][order], scores[order]))
    return out


def build(rows: DataFrame, n: int, dim: int, most: int = 8192, seed: int = 7) -> Index:
    """Fits centroids and bounds on a sample of about ``most`` rows, by hash; every
    row is indexed later. Lists grow with the square root of the rows."""
    part = F.xxhash64("vec_id", "v").bitwiseAND(0x7FFFFFFF) / float(1 << 31)
    got = rows.where(part * max(n, 1) < most).limit(2 * most).toArrow()
    x = matrix(got.column("v"), dim) if got.num_rows else np.zeros((0, dim))
    ids = got.column("vec_id").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    lists = max(8, int(np.ceil(np.sqrt(n) / 8)))
    centroids = lists_of(x, lists) if len(x) else np.zeros((1, dim))
    known = np.unique(ids, return_index=True)[1]  # a repeated id is one candidate here
    known = known[::max(1, len(known) // max(1, min(1024, n // 10)))]
    return Index(dim, rotation(dim, seed), centroids, x[known], ids[known])


def assigned(rows: DataFrame, index: Index) -> DataFrame:
    """Adds ``list``, each row's nearest centroid (any norm: by direction), and ``far``, its
    distance from there."""
    dim, centroids = index.dim, index.centroids

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), dim)
            near = (x @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32()),
                                              pa.array(np.linalg.norm(x - centroids[near], axis=1))], names=["vec_id", "v", "list", "far"])

    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, v {kind}, list int, far double")


def calibrate(placed: DataFrame, index: Index, k: int, every: int, recall: float, most: int = 128) -> int:
    """The fewest lists to look through so that a sample of about ``most`` queries
    finds ``recall`` of its true ``k`` nearest, by brute force over all rows."""
    part = F.xxhash64("v", "vec_id")
    got = placed.where(is_query(every)).orderBy(part, "vec_id").limit(most).select("vec_id", "v").toArrow()
    if not got.num_rows:
        return len(index.centroids)
    q, own, dim = matrix(got.column("v"), index.dim), got.column("vec_id").to_numpy(), index.dim

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, of = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            s = q @ matrix(batch.column(1), dim).T
            s[ids[None, :] == own[:, None]] = -np.inf
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            at = np.arange(len(q))[:, None]
            fine = np.isfinite(s[at, best]).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(at, best.shape).ravel()[fine]), pa.array(ids[best].ravel()[fine]),
                 pa.array(s[at, best].ravel()[fine]), pa.array(of[best].ravel()[fine])],
                names=["query_id", "vec_id", "score", "of_list"])

    near = placed.select("vec_id", "v", "list").mapInArrow(run, "query_id long, vec_id long, score double, of_list int")
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
            .select("query_id", "of_list").toArrow())
    if not true.num_rows:
        return len(index.centroids)
    place = np.argsort(np.argsort(-(q @ index.centroids.T), axis=1, kind="stable"), axis=1)
    depth = np.sort(place[true.column("query_id").to_numpy(), true.column("of_list").to_numpy()])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)]) + 1


def search(vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.96, sigmas: float = 3.0,
           columns: int = 16, block: int = 8192, chunk: int = 1024, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every``
    its ``k`` nearest found among rows with another id, by largest inner product,
    ties to the smaller id; ``recall`` is aimed at on a sample of queries.

    Vectors that are null, empty, zero, or hold null or non-finite components, and
    rows with a null id, take no part; shorter vectors are filled with zeros. If
    there are no more than ``k`` candidates, all are found. Repeated rows are
    candidates each; repeated equal queries are one. Other columns are dropped.

    A query first looks through its home lists: its nearest ones that hold ``k`` others.
    Its ``k``-th best there is the bound for the other lists, which give only rows that
    reach it, and are left out where its product with the centroid plus its norm times the
    list's radius does not. So what the lists give grows with the queries alone.

    Lists are split into blocks of about ``block`` rows, the queries that look
    through a list into chunks of about ``chunk``; one block with one chunk is one
    task's group. So a row is copied once for each chunk of its own list's queries,
    and not at all if none looks there.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")) \
        .where(F.col("vec_id").isNotNull() & usable(F.col("v"), zero=False))
    n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    index = build(rows, n, dim)
    placed = assigned(rows, index)
    lists = placed.groupBy("list").agg(F.count("*"), F.max("far")).collect()  # one row a list
    index.probes = calibrate(placed, index, k, every, recall) if n > 4 * k else len(index.centroids)
    parts = {c: max(1, -(-m // block)) for c, m, _ in lists}
    filled, radius = np.zeros(len(index.centroids), np.int64), np.zeros(len(index.centroids))
    for c, m, far in lists:
        filled[c], radius[c] = m, far
    centroids, probes, kind = index.centroids, index.probes, rows.schema["v"].dataType.simpleString()

    def cells(home: bool):
        def run(batches):
            for batch in batches:
                q, low = matrix(batch.column(1), dim), batch.column(3).to_numpy()
                product = q @ centroids.T
                near = np.argsort(-product, axis=1, kind="stable")
                homes = (np.cumsum(filled[near], axis=1) <= k).sum(axis=1) + 1  # hold k others, nearest first
                most = product + np.linalg.norm(q, axis=1, keepdims=True) * radius
                reach = most + 1e-9 * (1 + np.abs(most)) >= low[:, None]
                seen = [[int(c) for c in (row[:h] if home else row[h:max(probes, h)]) if home or reach[i, c]]
                        for i, (row, h) in enumerate(zip(near, homes))]
                seen = [[(c, b) for c in row for b in range(parts.get(c, 0))] for row in seen]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *(pa.array([[cell[i] for cell in row] for row in seen], pa.list_(pa.int32())) for i in (0, 1))],
                    names=["vec_id", "v", "of", "low", "lists", "blocks"])
        return run

    def look_through(queries: DataFrame, home: bool) -> DataFrame:
        """query_id, of, vec_id, score from the home lists, or from the others of ``queries``
        (vec_id, v, of, low)."""
        left = queries.mapInArrow(cells(home), f"vec_id long, v {kind}, of long, low double, lists array<int>, blocks array<int>")
        left = left.select("vec_id", "v", "of", "low", F.explode(F.arrays_zip("lists", "blocks")).alias("z")).select(
            "vec_id", "v", "of", "low", F.col("z.lists").alias("list"), F.col("z.blocks").alias("b"))
        visits = dict(left.where("b = 0").groupBy("list").count().collect())  # one row a list

        def of_list(values: dict[int, int]) -> F.Column:
            return F.element_at(F.lit([values.get(c, 0) for c in range(len(index.centroids))]), F.col("list") + 1)

        chunks = of_list({c: -(-m // chunk) for c, m in visits.items()})
        left = left.withColumn("c", F.pmod(F.xxhash64("v", "vec_id"), chunks).cast("int"))
        right = placed.drop("far").where(chunks > 0).withColumns({
            "b": F.pmod(F.xxhash64("vec_id", "v"), of_list(parts)).cast("int"),
            "c": F.explode(F.sequence(F.lit(0), chunks - 1))})

        def look(these: pa.Table, those: pa.Table) -> pa.Table:
            cols: list[list[np.ndarray]] = [[], [], [], []]
            if these.num_rows and those.num_rows:
                own, of, q = these.column("vec_id").to_numpy(), these.column("of").to_numpy(), matrix(these.column("v"), dim)
                low = np.maximum(bounds(index, q, own, k), these.column("low").to_numpy())
                found = scan(index, q, own, low, home, matrix(those.column("v"), dim), those.column("vec_id").to_numpy(), k, sigmas, columns)
                for at, (ids, scores) in enumerate(found):
                    for c, v in zip(cols, (np.full(len(ids), own[at]), np.full(len(ids), of[at]), ids, scores)):
                        c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.table([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(cols, kinds)],
                            names=["query_id", "of", "vec_id", "score"])

        key = ("list", "b", "c")
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
            look, "query_id long, of long, vec_id long, score double")

    queries = rows.where(is_query(every)).distinct().withColumn("of", F.xxhash64("vec_id", "v"))
    first = written(best_of(look_through(queries.withColumn("low", F.lit(float("-inf"))), True), k), "nearest")
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), "of", F.col("score").alias("low"))
    bounded = queries.join(kth, ["vec_id", "of"], "left").select(
        "vec_id", "v", "of", F.coalesce("low", F.lit(float("-inf"))).alias("low"))
    return k_best(first.drop("rank").unionByName(look_through(bounded, False)), k)
