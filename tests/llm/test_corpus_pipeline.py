"""The whole pipeline on small tables: each stage's rows against brute force."""

import random
import tempfile

import pytest

import corpus_pipeline
from invoxa.llm import langid

from .conftest import prose
from .test_pii import slow_base, slow_tel
from .test_simhash import slow_fingerprint, slow_groups
from .test_substring import slow as slow_repeats
from .test_text_models import TEXTS, check_packing


@pytest.fixture
def stages(spark, monkeypatch):
    """Runs the pipeline on a table; gives the rows read, those of each stage, in order."""
    def run(docs):
        folder, seen, real = tempfile.mkdtemp(prefix="invoxa-test-"), [], corpus_pipeline.written
        docs.write.parquet(f"{folder}/documents.parquet")
        monkeypatch.setattr(corpus_pipeline, "written", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
        last = corpus_pipeline.run(spark, folder).collect()
        monkeypatch.undo()
        read = spark.read.parquet(f"{folder}/documents.parquet")
        assert all(df.columns == read.columns for _, df in seen)
        return read, [(name, df.collect()) for name, df in [("read", read), *seen]] + [("packing", last)]
    return run


def slow_language(rows, model):
    """Row by row, each centroid in turn."""
    out = []
    for r in rows:
        codes = langid.letter_codes(r.text)
        if not len(codes) or not model.languages:
            continue
        x = model.vectors([codes])[0]
        cosine, limit = max(((float(x @ c), model.least(i, len(codes))) for i, c in enumerate(model.centroids)), key=lambda p: p[0])
        if cosine >= limit:
            out.append(r)
    return out


def slow_mask(text):
    spans = sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in [*slow_base(text).split(","), *slow_tel(text or "")] if s))
    out, pos = "", 0
    for a, b, kind in spans:
        if b > pos:
            out += text[pos:a] + f"[{kind.upper()}]" if a >= pos else ""
            pos = b
    return out + text[pos:] if spans else text


def with_text(row, text):
    new = {"text": text} | ({"n_chars": len(text)} if "n_chars" in row.asDict() else {})
    return tuple({**row.asDict(), **new}.values())


def same(got, want):
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))


def check(read, found):
    assert [name for name, _ in found] == ["read", *(name for name, _ in corpus_pipeline.STAGES)]
    start, known, apart, cut, masked, pieces = (rows for _, rows in found)
    same(known, slow_language(start, langid.train(langid.training_rows(read))))

    groups = slow_groups([slow_fingerprint(r.text) for r in known], 2)
    members = {g: [r for r, h in zip(known, groups) if h == g] for g in groups}
    assert len(apart) == len(members)
    left = list(map(str, apart))
    for rows in members.values():  # one of those with the smallest id, null last
        first = min((r.doc_id is None, r.doc_id or 0) for r in rows)
        left.remove(next(str(r) for r in rows if (r.doc_id is None, r.doc_id or 0) == first and str(r) in left))

    repeats = slow_repeats([(r.doc_id, r.text) for r in apart], 13)
    same(cut, [with_text(r, kept) if gone else r for r, (_, gone, kept) in zip(apart, repeats)])
    same(masked, [with_text(r, slow_mask(r.text)) if slow_mask(r.text) != r.text else r for r in cut])
    check_packing([(r.doc_id, r.text) for r in masked], pieces, 2048)


def test_every_stage(spark, stages):
    r = random.Random(21)
    passage = prose(r, 25)
    rows = []
    for i in range(150):
        lang = ["en", "fr", "de"][i % 3]
        text = " ".join(r.choice(TEXTS[lang]) + str(r.randint(0, 9)) for _ in range(r.randint(20, 80)))
        if i % 5 == 0:
            text += " " + passage
        if i % 7 == 0:
            text += " Phone 555-123-4567 or 555-987-6543, mail a.b@example.com, 10.0.0.1 é +1 (269) 555-3296"
        rows.append((i, text, lang, "s", len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "copy", rows[i][4]) for i in range(20)]
    rows += [(300, None, "en", "s", None), (301, "", "en", "s", 0), (302, "ქართული ენა არის", "en", "s", 16), (None, rows[3][1], "en", "t", rows[3][4])]
    read, found = stages(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3))
    check(read, found)
    counts = [len(x) for _, x in found[:5]]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    texts = {x.doc_id: x for x in found[4][1]}
    assert sum("Phone [TEL] or [TEL], mail [EMAIL]" in x.text for x in texts.values()) > 10
    assert sum(a.text != b.text for a, b in zip(*(sorted(found[k][1], key=lambda x: x.doc_id) for k in (2, 3)))) > 10
    assert all(x.n_chars == len(x.text) for x in texts.values())


def test_odd_and_clashing_columns(stages, odd_docs):
    clash = odd_docs.selectExpr("*", "text as masked", "doc_id as spans", "n_words as n_removed", "kept as row_id", "fp as text_hash",
                                "length(text) as n_chars")
    for docs in (odd_docs, clash):
        check(*stages(docs))


def test_empty(stages, no_docs):
    read, found = stages(no_docs)
    assert [len(rows) for _, rows in found] == [0] * 6
