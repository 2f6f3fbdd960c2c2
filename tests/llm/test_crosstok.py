import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from invoxa.llm import crosstok, queries
from tests.llm.conftest import prose

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", " a", "a  b ", "x\n\ny\tz ", "<|endoftext|> <s></s> <unk><0x41>", "▁a", "x▁ y", "日本語 テキスト", "é é ﬁ",
       "it's they'll I'M", "\x00 a b   c", "12 3456 7,8.9!", "\U0001F600\U0001F600 ok", "a" * 3000, "word. word, (word) word.\r\n",
       "naïve café Straße.", "﻿x", "don 't", "a \u0085 b", "x\x1c y"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=FILES[1])


def letters():
    from invoxa.llm.packing import byte_letters

    return {c: i for i, c in enumerate(byte_letters())}


def brute(both, text):
    """(first ids, second ids, groups, links) by the libraries and by byte offsets."""
    a, b = both
    if not text:
        return [], [], [], []
    ids_a, ids_b, of = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), letters()
    raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return [], [], [], []

    def ends(raw):
        out, n = {}, 0
        for k, r in enumerate(raw, 1):
            n += len(r)
            out[n] = k
        return out

    end_a, end_b = ends(raw_a), ends(raw_b)
    groups, links, x, y = [], [], 0, 0
    for e in sorted(end_a.keys() & end_b.keys()):
        groups.append((ids_a[x:end_a[e]], ids_b[y:end_b[e]]))
        links.append((ids_a[end_a[e] - 1], ids_b[end_b[e] - 1]))
        x, y = end_a[e], end_b[e]
    return ids_a, ids_b, groups, links


def shown(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def test_texts(both):
    r = random.Random(2)
    texts = ODD + [prose(r, r.randint(1, 80)) for _ in range(40)]
    alphabet = "ab c  'sé▁\n\t12., \U0001F600Z"
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    pair = crosstok.Pair(*FILES)
    for some in (texts, texts[::-1], texts[:3]):
        for text, (n_a, n_b, groups, links) in zip(some, pair.align([t.encode() for t in some])):
            a, b, want, want_links = brute(both, text)
            assert (n_a, n_b, groups) == (len(a), len(b), shown(want)), text
            assert [(x >> 32, x & 0xFFFFFFFF) for x in links.tolist()] == want_links


def test_small_memo(both):
    pair = crosstok.Pair(*FILES)
    pair.parts.most = pair.windows.most = 2000
    r = random.Random(3)
    for _ in range(30):
        text = prose(r, 50)
        assert pair.align([text.encode()])[0][2] == shown(brute(both, text)[2])


def test_null_and_broken_bytes():
    got = crosstok.Pair(*FILES).align([None, b"", b"\xff\xfe a", b"ok"])
    assert [g[:3] for g in got[:3]] == [(0, 0, "")] * 3 and got[3][0] > 0


def test_query(spark, both, tmp_path):
    r = random.Random(6)
    texts = [None, *ODD, *(prose(r, r.randint(0, 40)) for _ in range(60))] + ["same words again"] * 30
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, "a"), (1, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    done = [(d, *brute(both, t)) for d, t in rows]
    counts = Counter(link for row in done for link in row[4])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    want = [(d, len(a), len(b), len(g), len(k), sum(counts[x] == top[x[1]] for x in k), sum(counts[x] for x in k),
             hashlib.sha256(shown(g).encode()).hexdigest() if g else "") for d, a, b, g, k in done]
    got = [tuple(x) for x in queries.op11_crosstok(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_odd_rows(spark, odd_docs, no_docs):
    got = crosstok.corpus_counts(crosstok.align(odd_docs, *FILES, chunk_bytes=2000)).collect()
    assert len(got) == odd_docs.count() and got[0]["groups"] is not None
    assert crosstok.corpus_counts(crosstok.align(no_docs, *FILES)).collect() == []
