import numpy as np
import pandas as pd
import pytest
import xxhash

from invoxa.llm import simhash as S

from .conftest import prose


def slow_fingerprint(text):
    """Bit by bit, from the definition."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps, radius):
    fps = np.asarray(fps, np.uint64)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint(rng):
    texts = [None, "", "  \x0b\x0c", "one", "One TWO", "a b c", "a b a b a b a b", prose(rng, 200), "É é ÀB", "x\x1cy z w"]
    assert [S.fingerprint(t.encode() if t is not None else None) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_blocks_of_shingles_change_nothing(rng):
    text = prose(rng, 500).encode()
    assert S.fingerprint(text, block=7) == S.fingerprint(text) == slow_fingerprint(text.decode())


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2 ** 63, 4, dtype=np.uint64)
    out = []
    for i in range(n):
        x = int(centres[i % 4])
        for b in rng.integers(0, 64, rng.integers(0, 7)):
            x ^= 1 << int(b)
        out.append(x)
    return np.unique(np.array(out + [0, 1, 3, 7, 2 ** 64 - 1], np.uint64))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_what_pairs_connect(spark, radius):
    fps = clustered(600, radius)
    signed = fps.view(np.int64)
    links = S.links(spark.createDataFrame(pd.DataFrame({"fp": signed})), radius, 5)
    found = {r.node: r.root for r in S.components(links).collect()}
    expected = slow_groups(fps, radius)
    for i, want in enumerate(expected):
        mates = {int(signed[j]) for j, w in enumerate(expected) if w == want}
        assert found.get(int(signed[i]), int(signed[i])) == min(mates)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i + 1, i) for i in range(200)] + [(1000 + i, 999) for i in range(1, 300)]
    found = {r.node: r.root for r in S.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 201)}, **{1000 + i: 999 for i in range(1, 300)}}
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    rows = odd_docs.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    groups = slow_groups(fps, 2)
    ids = {g: min((r.doc_id for r, h in zip(rows, groups) if h == g and r.doc_id is not None), default=None) for g in groups}
    want = sorted(map(str, ((r.doc_id, f, ids[g]) for r, f, g in zip(rows, fps, groups))))
    got = S.near_duplicates(odd_docs).collect()
    assert sorted(str((r.doc_id, r.fp % 2 ** 64, r.component_id)) for r in got) == want
    assert S.near_duplicates(no_docs).count() == 0


def test_drop_keeps_one_of_each_group(odd_docs, no_docs):
    kept = S.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    groups = slow_groups([slow_fingerprint(r.text) for r in odd_docs.collect()], 2)
    rows = kept.collect()
    assert len(rows) == len(set(groups))
    assert [r.doc_id for r in rows if r.text and r.text.startswith("same text")] == [8]
    assert [r.doc_id for r in rows if not (r.text or "").strip()] == [1]
    assert S.drop_near_duplicates(no_docs).count() == 0
