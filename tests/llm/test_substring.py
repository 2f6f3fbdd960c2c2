import random

import pytest

from invoxa.llm import substring

from .conftest import prose


def slow(rows, length):
    """(n_words, n_removed, kept) of each row, from the definition."""
    far = 1 << 62
    words = [(r[1] or "").encode().split() for r in rows]
    ids = [far if r[0] is None else r[0] for r in rows]
    first = {}
    for i, w in zip(ids, words):
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            first[key] = min(first.get(key, far), i)
    out = []
    for i, w in zip(ids, words):
        lost = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k:k + length])] < i:
                lost[k:k + length] = [True] * length
        out.append((len(w), sum(lost), b" ".join(x for x, y in zip(w, lost) if not y).decode()))
    return out


def same(spark, rows, **options):
    length = options.get("length", 13)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.remove_repeats(df, **options).collect()
    want = slow(rows, length)
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in got) == \
        sorted(str((rows[i][0], *want[i])) for i in range(len(rows)))


@pytest.mark.parametrize("length,period", [(13, 7), (5, 3), (3, 3), (14, 13)])
def test_against_brute_force(spark, length, period):
    r = random.Random(length)
    passages = [prose(r, n) for n in (length - 1, length, length + 1, 2 * length, 60)]
    rows = []
    for i in range(80):
        parts = [r.choice(passages) if r.random() < 0.5 else prose(r, r.randint(0, 20)) for _ in range(r.randint(0, 5))]
        rows.append((r.randint(0, 60), " ".join(parts)))
    same(spark, rows, length=length, period=period, per_batch=9)


def test_few_words_repeat_often(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 40)))) for i in range(40)]
    same(spark, rows, per_batch=7)
    same(spark, [(i, "a " * n) for i, n in enumerate((30, 13, 12, 14, 0, 100))], per_batch=2)


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    found = substring.remove_repeats(odd_docs, per_batch=4)
    want = slow(rows, 13)
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in found.collect()) == \
        sorted(str((rows[i][0], *want[i])) for i in range(len(rows)))
    assert found.select("row.*").columns == odd_docs.columns
    assert sorted(map(str, found.select("row.*").collect())) == sorted(map(str, odd_docs.collect()))
    assert substring.remove_repeats(no_docs).count() == 0


def test_text_is_shuffled_once(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string").write.parquet(path)
    out = substring.remove_repeats(spark.read.parquet(path))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan
