import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from invoxa.llm import bpe, langid, packing, url_filter

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", " ", "  ", "   ", "\n", "\t", "É", "e\u0301", "w\u030a", "日本", "😀", "'s", "'", "1", "²", "!", "...", "The", " the",
         "\r\n", "\x1c", "ß", "ing", "İ", "ΑΣ", ",", "\xa0", "_", "don't", "<|endoftext|>", "ŉ", "ſ", "K", "ª", "aaaa", "\x00"]


def mixed(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 16))) for _ in range(n)]


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_transducer_equals_tiktoken(tik):
    mine = bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    for t in mixed(3000, 1):
        assert np.frombuffer(mine.encode(t), np.int32).tolist() == tik.encode_ordinary(t)


def test_transducer_without_room_for_states():
    ranks = bpe.read_ranks(RANKS)
    r, tokens = random.Random(2), list(ranks)
    small = bpe.Transducer(ranks, most=50)
    for _ in range(500):
        piece = b"".join(r.choice(tokens) for _ in range(3))
        assert tuple(small.encode(piece)) == ((ranks[piece],) if piece in ranks else bpe.merge_pairs(piece, ranks))
    assert len(small.states) <= 50
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0, b"b": 1}).encode(b"ac")


def test_small_vocabulary_against_merging():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"bb": 259, b"aabb": 260, b"ba": 261, b"aaa": 262}
    t, r = bpe.Transducer(ranks), random.Random(3)
    for _ in range(3000):
        piece = bytes(r.choice(b"abc") for _ in range(r.randint(1, 14)))
        assert tuple(t.encode(piece)) == ((ranks[piece],) if piece in ranks else bpe.merge_pairs(piece, ranks))


def test_stream_decoding():
    data = "aé日😀".encode() + b"\xff\xe2\x82" + "ok".encode()
    for size in (1, 2, 3, 5):
        s = bpe.Utf8Stream()
        text = "".join(s.feed(data[i:i + size]) for i in range(0, len(data), size)) + s.close()
        assert text.startswith("aé日😀") and text.endswith("ok") and "\ufffd" in text and not s.valid
    s = bpe.Utf8Stream()
    assert s.feed("日".encode()[:2]) == "" and s.feed("日".encode()[2:]) == "日" and s.close() == "" and s.valid


def test_bpe_rows(spark, odd_docs, no_docs, tik):
    rows = odd_docs.collect()
    got = bpe.round_trip(odd_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(str((r.doc_id, r.ids, r.decoded)) for r in got) == sorted(
        str((r.doc_id, tik.encode_ordinary(r.text or ""), r.text or "")) for r in rows)
    encoded = bpe.encode(odd_docs, RANKS, public_tokenizers.PATTERN)
    assert sorted(str((r.doc_id, r.text, r.valid)) for r in bpe.decode(encoded, RANKS).collect()) == sorted(
        str((r.doc_id, r.text or "", True)) for r in rows)
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [50000, 255])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.valid for r in bpe.decode(nulls, RANKS).collect()}[1]


def word_ids(texts):
    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_word_tokenizer_equals_library():
    texts = mixed(3000, 4)
    got = packing.WordTokenizer(WORD).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == word_ids(texts)


def test_query_gives_special_tokens_as_the_library_does(spark, tmp_path):
    from invoxa.llm import queries

    texts = mixed(300, 5) + ["a <|endoftext|>b", "<|startoftext|><|endoftext|> x", "<|ENDOFTEXT|>", "<|endof text|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = Tokenizer.from_file(WORD)
    want = [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert any(49407 in x for x in want) and any(49406 in x for x in want)
    assert {r.doc_id: r.doc_tokens for r in queries.op5_packing(spark, str(tmp_path)).collect()} == {
        i: len(x) + 1 for i, x in enumerate(want)}
    got = packing.WordTokenizer(WORD, special=True).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def check_packing(rows, pieces, capacity):
    """Each id in one piece, no gaps, none too long."""
    want = sorted(str((r[0], ids + [1])) for r, ids in zip(rows, word_ids([r[1] or "" for r in rows])))
    sequences, docs = {}, {}
    for p in pieces:
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert ids
        sequences.setdefault(p.sequence_id, []).append((p.offset, len(ids)))
        docs.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, ids))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    if len({r[0] for r in rows}) == len(rows):
        got = []
        for (doc, total), parts in docs.items():
            ids = []
            for start, part in sorted(parts):
                assert start == len(ids)
                ids += part
            assert len(ids) == total
            got.append(str((doc, ids)))
        assert sorted(got) == want
    return len(sequences) * capacity, sum(len(p.ids) // 4 for p in pieces)


@pytest.mark.parametrize("capacity,pool", [(64, 10), (2048, 2048), (7, 3)])
def test_packing(spark, capacity, pool):
    r = random.Random(6)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "x1", "é"]) for _ in range(r.choice([0, 3, 20, 200])))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")
    room, used = check_packing(rows, packing.pack(df, WORD, capacity=capacity, pool=pool).collect(), capacity)
    assert room - used < 2 * capacity  # less than one sequence a partition


def test_packing_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    room, used = check_packing(rows, packing.pack(odd_docs, WORD).collect(), 2048)
    assert used == sum(len(x) + 1 for x in word_ids([r[1] or "" for r in rows]))
    assert packing.pack(no_docs, WORD).count() == 0


def test_packer_balances_cost():
    packer = packing.Packer(100, 1.0, 0.1, 50)
    for d in range(40):
        packer.add(d, 10 if d % 2 else 40)
    cost, longest = {}, {}
    for _, _, n, s, _ in packer.flush(last=True):
        cost[s] = cost.get(s, 0) + packer.cost(n)
        longest[s] = max(longest.get(s, 0), n)
    assert len(cost) == 10 and max(cost.values()) <= 1.05 * min(cost.values())


TEXTS = {"en": ["the", "of", "and", "thing", "with", "house"], "fr": ["le", "de", "élève", "être", "maison", "où"],
         "de": ["der", "und", "straße", "größe", "haus", "über"]}


def labelled(spark, n=240):
    r = random.Random(8)
    rows = []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        rows.append((i, " ".join(r.choice(TEXTS[lang]) for _ in range(r.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark):
    docs = labelled(spark)
    model = langid.train(langid.training_rows(docs), most=30)
    assert sorted(set(model.languages)) == ["de", "en", "fr"]
    got = langid.identify(docs, model).join(docs, "doc_id").where(langid.held_out())
    assert got.count() > 50
    assert got.where("lang = lang_pred and not rejected").count() >= 0.95 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_short_clean_texts_are_kept(spark):
    """A lone short text can be a centroid of its own; texts a little like it stay."""
    r = random.Random(13)
    lone = {"en": "Wyvkyzqxpjbg.", "fr": "Wyvkyzqxpjbg.", "de": "Wyvkyzqxpjbg."}
    rows = [tuple(x) for x in labelled(spark).collect()] + [(1000 + i, t, lang) for i, (lang, t) in enumerate(lone.items())]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    short = [(i, "".join(r.choice(["wyvk", "zqx", "jbg", *"abdefhiklmnoprstuw"]) for _ in range(r.randint(3, 7))) + ".") for i in range(300)]
    got = langid.identify(spark.createDataFrame(short, "doc_id long, text string"), model)
    assert got.where("score > 0.25").count() > 20
    assert got.where("rejected and score > 0.25").collect() == []


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.train(langid.training_rows(labelled(spark)), most=30)
    rows = {(r.doc_id, r.lang_pred == "und", r.rejected) for r in langid.identify(odd_docs, model).collect()}
    assert {(1, True, True), (2, True, True), (3, True, True), (None, True, True)} <= rows
    assert langid.identify(odd_docs, model).count() == odd_docs.count()
    strange = spark.createDataFrame([(1, "ქართული ენა არის"), (2, "123 !!"), (3, "the house and the thing")], "doc_id long, text string")
    assert {r.doc_id: r.rejected for r in langid.identify(strange, model).collect()} == {1: True, 2: True, 3: False}
    kept = langid.drop_rejected(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.where("text is null").count() == 0
    assert langid.identify(no_docs, model).count() == langid.drop_rejected(no_docs, model).count() == 0
    nothing = langid.train(no_docs.select("text", "lang"))
    assert {r.lang_pred for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_long_texts_are_counted_in_blocks():
    from invoxa.llm.common import ngram_counts

    codes = np.random.default_rng(0).integers(97, 110, 5000).astype(np.uint32)
    docs = [codes, codes[:3], codes[:0], codes[:700]]
    assert (ngram_counts(docs, (1, 2, 3), 8, block=64) == ngram_counts(docs, (1, 2, 3), 8)).all()
    assert ngram_counts(docs, (2,), 8).sum() == 4999 + 2 + 699


RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    ends = [rest.index(c) for c in "/?#" if c in rest]
    host = rest[:min(ends, default=len(rest))]
    rest = rest[len(host):]
    ends = [rest.index(c) for c in "?#" if c in rest]
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:min(ends, default=len(rest))]


def slow_rule(host, path):
    fit = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
           and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


URLS = [None, "", "x", "http://", "http://a.net", "http://a.net/", "HTTP://WWW.Example.NET/en/1?x#y", "https://example.net/enx", "s://net/a",
        "s://anet/x", "s://x.org/fr/a", "s://x.org/fr", "s://example.com/de/?q=/fr/", "s://a.example.com?/de/", "s://É.net/é", "a://b://c.net/",
        "s://x.example.com/de/a#b", "://org/fr/", "s:// sp.net /x\n/y"]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "s") for i, u in enumerate(URLS)] + [(None, URLS[5], None, None)],
                                  "page_id long, url string, host string, score string")
    model = url_filter.train(url_filter.rule_labels(pages, RULES))
    got = url_filter.judge_urls(pages, RULES, model).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        url = URLS[r.page_id] if r.page_id is not None else URLS[5]
        assert (r.host, r.path) == slow_parts(url) and r.rule == slow_rule(r.host, r.path)
        assert r.verdict == (RULES[r.rule] if r.rule else "block" if r.score >= 0.5 else "allow")
    assert url_filter.judge_urls(pages.where("false"), RULES, model).count() == 0


def test_url_classifier_held_out(spark):
    r = random.Random(11)
    def url(bad):
        host = r.choice(["casino", "xxbet", "winpoker"] if bad else ["library", "school", "science"]) + str(r.randint(0, 99))
        return f"http://{host}.example/{r.choice(['bonus', 'spin'] if bad else ['article', 'book'])}/{r.randint(0, 9999)}"
    rows = [(url(i % 2), "block" if i % 2 else "allow") for i in range(300)]
    model = url_filter.train(spark.createDataFrame(rows[:200], "url string, label string"), most=150)
    test = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(rows[200:])], "page_id long, url string, label string")
    got = url_filter.judge_urls(test, {}, model).join(test, "page_id")
    assert got.where("verdict = label").count() >= 95
    one = url_filter.train(spark.createDataFrame([("s://a/b", "block"), (None, "allow")], "url string, label string"))
    assert {x.verdict for x in url_filter.judge_urls(test, {}, one).collect()} == {"block"}
    none = url_filter.train(test.select("url", "label").where("false"))
    assert {x.verdict for x in url_filter.judge_urls(test, {}, none).collect()} == {"allow"}


OTHERS = {  # the first article of the Declaration of Human Rights
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
          "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
          "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel "
          "bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience "
          "and should act towards one another in a spirit of brotherhood.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt "
          "und sollen einander im Geist der Brüderlichkeit begegnen."}


def test_unlike_texts_are_rejected_and_clean_ones_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.train(langid.training_rows(docs))
    got = langid.identify(docs, model).join(docs, "doc_id")
    lost = got.where("rejected and n_chars > 0").collect()
    assert len(lost) <= 3 and not [r for r in lost if not r.text.isupper()]
    r = random.Random(1)
    texts = [("rnd", "".join(r.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(n))) for n in (100, 400, 4000)]
    texts += [*OTHERS.items()] + [(k, OTHERS[k] * 20) for k in ("pl", "fi", "hu")]
    texts += [(k, w) for k in ("en", "de") for w in OTHERS[k].split()[::6]]
    rows = spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(texts)], "doc_id long, text string, k string")
    found = langid.identify(rows, model).join(rows, "doc_id")
    assert found.where("rejected and k in ('en', 'de')").collect() == []
    assert found.where("not rejected and k not in ('en', 'de')").collect() == []
