import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from invoxa.llm import queries, runs


def brute(words, least=6, times=4):
    n, out = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i:j + q]
            if j > i and len(part) >= max(least, times * q):
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.add((i, len(part), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.sampled_from([(6, 4), (2, 2), (9, 3), (1, 2)]))
def test_every_run_of_small_alphabets(words, shape):
    assert runs.runs_of(words, *shape) == brute(words, *shape)


def test_runs_in_prose():
    r = random.Random(3)
    for _ in range(200):
        words = [r.randrange(40) for _ in range(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            at, p = r.randrange(len(words) + 1), r.randint(1, 20)
            words[at:at] = (words[at:at + p] or [7]) * r.randint(2, 9)
        assert runs.runs_of(words) == brute(words)
        dropped = {i for s, n, p in brute(words) for i in range(s + p, s + n)}
        assert runs.collapse(words, runs.runs_of(words)) == [w for i, w in enumerate(words) if i not in dropped]


def test_long_periodic_text():
    words = [i % 700 for i in range(30_000)]
    assert runs.runs_of(words) == [(0, 30_000, 700)]
    assert runs.runs_of([1] * 50_000) == [(0, 50_000, 1)]


def expected(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("planted", [True, False])
def test_query(spark, odd_docs, no_docs, tmp_path, planted):
    ids = [d for d in range(4000) if (zlib.crc32(str(d).encode()) % 10 == 0) == planted][:60]
    r = random.Random(4)
    rows = [(d, " ".join(r.choice("abcdefgh") for _ in range(r.randint(0, 120)))) for d in ids]
    rows += [(ids[0], "x " * 40), (ids[0], "x " * 40), (None, "y " * 9), (ids[1], None), (ids[2], ""), (ids[3], "b b " * 7)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(row) for row in queries.op13_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str(expected(*row)) for row in rows)


def test_odd_rows(spark, odd_docs, no_docs):
    got = runs.find_runs(odd_docs).collect()
    assert len(got) == odd_docs.count()
    for row in got:
        if row["doc_id"] in (1, 2, 3):
            assert (row["n_words"], row["runs"], row["kept"]) == (0, [], "")
        if row["doc_id"] in (8, 9):
            assert [tuple(x) for x in row["runs"]] == [(0, 60, 3)] and row["kept"] == "same text here"
    assert runs.find_runs(no_docs).collect() == []
