import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from invoxa.llm import queries
from invoxa.llm import suffix_tree as tree

END, START = None, 0


def tokens(text):
    return [*(text or "").encode().lower().split(), END]


def brute(rows, depth=2, prior=8.0, least=16, divergence=6.0, add=0.1):
    """Scores by plain counting; ``rows`` are (id, held out, text)."""
    n, seen = [Counter() for _ in range(depth + 1)], [Counter() for _ in range(depth + 1)]
    for _, held, text in rows:
        words = tokens(text)
        for i, w in enumerate(words):
            for k in range(depth + 1):
                if not held and i >= k - 1:
                    context = ((START, *words) if i < k else tuple(words))[max(i - k, 0):][:k]
                    n[k][(*context, w)] += 1
                    seen[k][context] += 1
    size, vocabulary = sum(n[0].values()), len(n[0])

    def probabilities(words, i, less):
        out = [(max(n[0][(words[i],)] - less, 0) + add) / (size - less + add * (vocabulary + 1))]
        for k in range(1, depth + 1):
            if i < k - 1:
                break
            context = ((START, *words) if i < k else tuple(words))[max(i - k, 0):][:k]
            out.append((max(n[k][(*context, words[i])] - less, 0) + prior * out[-1]) / (max(seen[k][context] - less, 0) + prior))
        return out

    def context_of(words, i, k):
        return ((START, *words) if i < k else tuple(words))[max(i - k, 0):][:k]

    gain = Counter()
    for _, held, text in rows:
        if not held:
            words = tokens(text)
            for i in range(len(words)):
                p = probabilities(words, i, 1)
                for k in range(1, len(p)):
                    gain[context_of(words, i, k)] += math.log(p[k] / p[k - 1])
    out = []
    for doc, held, text in rows:
        words, base, best = tokens(text), 0.0, 0.0
        for i in range(len(words)):
            p, k = probabilities(words, i, 0), 0
            while k + 1 < len(p) and seen[k + 1][context_of(words, i, k + 1)] >= least and gain[context_of(words, i, k + 1)] > divergence:
                k += 1
            base += math.log10(p[0])
            best += math.log10(p[k])
        out.append((doc, bool(held), len(words), sum(n[0][(w,)] > 0 for w in words), size, base, best))
    return out


def chain(r, n):
    """Prose in which some words call for others."""
    follow = {"a": "b", "b": "c", "x": "y"}
    out = []
    for _ in range(n):
        last = out[-1] if out else "x"
        out.append(follow[last] if last in follow and r.random() < 0.8 else r.choice(["a", "b", "c", "x", "y", "Z", "w%d" % r.randint(0, 30)]))
    return " ".join(out)


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-6)


@pytest.mark.parametrize("depth,least,divergence", [(2, 3, 1.0), (1, 2, 0.5), (3, 2, 0.2)])
def test_scores(spark, depth, least, divergence):
    r = random.Random(depth)
    rows = [(i, r.random() < 0.2, chain(r, r.randint(0, 60))) for i in range(60)] + [(60, False, None), (61, True, ""), (3, False, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, held boolean, text string").repartition(3)
    got = tree.score(df, F.col("held"), depth=depth, least=least, divergence=divergence, prior=4.0, chunk_bytes=1500).drop("states")
    want = brute(rows, depth, 4.0, least, divergence)
    same([tuple(x) for x in got.collect()], want)
    assert sum(w[6] for w in want) > sum(w[5] for w in want)


def test_query(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, chain(r, r.randint(0, 90))) for i in range(150)] + [(5, "a b c " * 30)] * 3 + [(None, "null id"), (20, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = [(d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, t) for d, t in rows]
    got = [tuple(x) for x in queries.op12_suffix_tree(spark, str(tmp_path)).collect()]
    same(got, brute(held, **queries.SUFFIX_TREE))


def test_odd_rows(spark, odd_docs, no_docs):
    got = tree.score(odd_docs, tree.held_out_tenth(), chunk_bytes=3000).collect()
    assert len(got) == odd_docs.count() and all(math.isfinite(x["score"]) for x in got)
    assert tree.score(no_docs, tree.held_out_tenth()).collect() == []


def test_planes():
    for kind in (np.uint64, np.uint32, np.float32, np.uint8):
        x = np.arange(7).astype(kind) * 3
        assert (tree.from_planes(tree.planes(x), kind) == x).all()
        assert len(tree.from_planes(tree.planes(x[:0]), kind)) == 0
