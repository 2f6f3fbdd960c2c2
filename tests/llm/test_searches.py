import math
import random

import numpy as np
import pytest

from invoxa.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank int, b string"


def table(spark, vectors):
    """(id, vector) rows with extra columns whose names clash."""
    return spark.createDataFrame([(i, v, "x", None, "y") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, k, change, zero):
    rows = [(i, [change(float(np.float32(x))) for x in v], [float(np.float32(x)) for x in v]) for i, v in vectors
            if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for q, a, _ in rows:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b, _ in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def some_vectors(n, dim, seed, spread=0.3):
    r = random.Random(seed)
    return [(i, [r.gauss(0, spread) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("n,dim,k", [(300, 5, 20), (700, 16, 20), (130, 1, 3), (15, 4, 20), (1, 3, 20)])
def test_topk_is_exact(spark, n, dim, k):
    vectors = some_vectors(n, dim, n)
    found = got(topk.search(table(spark, vectors), k=k, block=90, chunk=4))
    want = brute(vectors, k, lambda x: math.floor(64 * x), True)
    assert found == {q: v for q, v in want.items() if v}


def test_topk_ties_and_large_values(spark):
    ties = [(i, [1.0, -0.5] if i % 3 else [0.0, 0.0]) for i in range(200)]
    assert got(topk.search(table(spark, ties), block=64, chunk=3)) == brute(ties, 20, lambda x: math.floor(64 * x), True)
    large = [(i, [(-1) ** i * 1e5 * i, 3e5, 0.001 * i]) for i in range(80)]
    assert got(topk.search(table(spark, large))) == brute(large, 20, lambda x: math.floor(64 * x), True)
    huge = [(i, [1e30 * (i - 5), 1.0]) for i in range(25)]  # beyond a long: all ends are equal
    assert got(topk.search(table(spark, huge)))[20] == [(i, 2 ** 63 - 1) for i in range(6, 25) if i != 20] + [
        (5, 64 * 64)] + [(0, -2 ** 63)]


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    fine = some_vectors(60, 4, 3)
    return fine + [(100, None), (120, []), (140, [1.0, None, 0.0, 0.0]), (160, [nan, 0.0, 0.0, 0.0]), (180, [0.0, inf, 0.0, 0.0]),
                   (200, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (220, [0.5, 0.25]), (220, [0.5, 0.25])]


def test_odd_vectors(spark):
    vectors = odd_vectors()
    padded = [(i, v + [0.0] * (4 - len(v)) if v else v) for i, v in vectors]
    assert got(topk.search(table(spark, vectors))) == brute(padded, 20, lambda x: math.floor(64 * x), True) \
        or _same_but_repeats(got_rows(topk.search(table(spark, vectors))), padded)
    found = ann.search(table(spark, vectors)).collect()
    assert not {100, 120, 140, 160, 180, 200} & {r.query_id for r in found} | {100, 120, 140, 160, 180, 200} & {r.vec_id for r in found}
    for search in (topk.search, ann.search):
        assert search(table(spark, vectors).where("false")).count() == 0


def got_rows(df):
    return {(r.query_id, r.rank, r.vec_id) for r in df.collect()}


def _same_but_repeats(rows, vectors):
    want = brute(vectors, 20, lambda x: math.floor(64 * x), True)
    return rows == {(q, n + 1, i) for q, best in want.items() for n, (i, _) in enumerate(best)}


@pytest.mark.parametrize("spread", [0.05, 0.2, 0.5])
def test_ann_scan_keeps_neighbours_along_the_query(spread):
    """Rows near a query hold about the same share of the product in all columns: their
    rest is no random number around zero."""
    r = np.random.default_rng(3)
    centre = r.standard_normal((30, 64))
    x = (centre[np.arange(3000) % 30] + spread * r.standard_normal((3000, 64))) * r.uniform(0.5, 2, (3000, 1))
    ids, own = np.arange(3000), np.arange(0, 3000, 20)
    true = x[own] @ x.T
    true[np.arange(len(own)), own] = -np.inf
    best = np.argsort(-true, axis=1)[:, :20]
    low = np.take_along_axis(true, best, axis=1)[:, -1]
    index = ann.Index(64, ann.rotation(64, 7), x[:1], x[:0], ids[:0])
    found = ann.scan(index, x[own], own, low * (1 - 1e-12), False, x, ids, 20, 3.0, 16)
    assert np.mean([len(np.intersect1d(f, b)) / 20 for (f, _), b in zip(found, best)]) >= 0.98


def test_ann_recall_on_clustered_rows(spark):
    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(32)] for _ in range(40)]
    vectors = [(i, [x + r.gauss(0, 0.2) for x in centres[i % 40]]) for i in range(3000)]
    found, want = got(ann.search(table(spark, vectors))), brute(vectors, 20, float, False)
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_ann_recall_scores_and_order(spark):
    vectors = some_vectors(3000, 24, 9)
    found, want = got(ann.search(table(spark, vectors), block=200, chunk=40)), brute(vectors, 20, float, False)
    assert found.keys() == want.keys() and all(len(v) == 20 for v in found.values())
    assert np.mean([len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    exact = {i: np.float32(v).astype(float) for i, v in vectors}
    for q, best in found.items():
        assert best == sorted(best, key=lambda b: (-b[1], b[0]))
        assert all(abs(s - float(exact[q] @ exact[i])) < 1e-12 for i, s in best)


def test_ann_common_vector_and_few_rows(spark):
    r = random.Random(2)
    vectors = [(i, [1.0, 2.0, 3.0] if i % 3 == 0 else [r.gauss(0, 1) for _ in range(3)]) for i in range(400)]
    found, want = got(ann.search(table(spark, vectors))), brute(vectors, 20, float, False)
    for q in want:
        if q % 3 == 0:
            assert len(found[q]) == 20
    few = some_vectors(21, 3, 1)
    assert got(ann.search(table(spark, few))).keys() == {0, 20}
    assert all(len(v) == 20 for v in got(ann.search(table(spark, few))).values())


def test_sliced_scores():
    rng = np.random.default_rng(0)
    values = rng.integers(-40, 40, (150, 7))
    block = topk.SlicedBlock(np.arange(150), values)
    for _ in range(20):
        q = rng.integers(-30, 30, 7)
        best = block.best(q, 10, 5)
        scores = values @ q
        want = sorted((i for i in range(150) if i != 5), key=lambda i: (-scores[i], i))[:10]
        assert sorted(best.tolist()) == sorted(want)


def test_calibration_reports_enough_lists(spark):
    vectors = some_vectors(1000, 8, 4)
    rows = table(spark, vectors).selectExpr("vec_id", "embedding as v")
    index = ann.build(rows, 1000, 8)
    placed = ann.assigned(rows, index)
    assert placed.count() == 1000
    few, many = (ann.calibrate(placed, index, 20, 20, r) for r in (0.5, 1.0))
    assert 1 <= few <= many <= len(index.centroids)
