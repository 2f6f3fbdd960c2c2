import hashlib
import random
import re
import tempfile

from pyspark.sql import functions as F

from invoxa.llm import pii, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")),
                    "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]():
                out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


PARTS = ["a@b.c", "+", "1", "22", "4111 1111 1111 1111", "4539578763621486", ".", "-", " ", "x@y..z", "@", "é", "😀", "+1 (269) 555-3296",
         "192.168.0.1", "256.1.1.1", "\n", "tel: ", "0800 555 1234", "1.2.3.4.5.6.7.8", "a", "_", "%", "000", "+49 30 12345678 ", "(",
         "00001.2.3.4", "4111-1111-1111-1111", "8" * 25]


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    rows = pii.find_pii(df).select("doc_id", pii.spans_text(base).alias("base"), pii.spans_text(F.col("spans")).alias("all"),
                                   pii.mask(F.col("text"), F.col("spans")).alias("masked")).collect()
    return {r.doc_id: r for r in rows}


def test_base_spans_against_definition(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(1500)] + [None, ""]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert got[i].base == slow_base(t), t


def test_query_digests(spark):
    r = random.Random(4)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 14))) for _ in range(200)] + [None, ""]
    folder = tempfile.mkdtemp(prefix="invoxa-test-")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    for row in queries.op6_pii(spark, folder).collect():
        base = slow_base(texts[row.doc_id])
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        counts = [sum(x.startswith(k + ":") for x in base.split(",")) for k in PATTERNS]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == counts
        assert set(filter(None, base.split(","))) <= set(row.spans.split(","))


def test_long_texts_stay_linear(spark):
    texts = ["1 " * 50_000, "x@" + "a." * 50_000 + "b", "a@b.co " * 3000, "4111111111111111 " * 2000, "a" * 300_000, "9" * 300_000]
    got = found(spark, texts)
    for i, t in enumerate(texts[:4]):
        assert got[i].base == slow_base(t)
    assert got[4].base == got[5].base == ""


def test_checksums_and_context_add_spans(spark):
    texts = ["Pay to IBAN DE89 3704 0044 0532 0130 00 now", "DE89370400440532013000", "DE88370400440532013000",
             "call tel: 0800 555 1234", "order 0800 555 1234", "GB82WEST12345698765432, GB82WEST12345698765433"]
    got = found(spark, texts)
    assert [got[i].all for i in range(6)] == ["iban:12:39", "iban:0:22", "", "tel:10:23", "", "iban:0:22"]
    assert got[0].masked == "Pay to IBAN [IBAN] now"


def test_scores(spark):
    df = spark.createDataFrame([(1, "my card 4111111111111111"), (2, "4111111111111111")], "doc_id long, text string")
    rows = {r.doc_id: r.spans[0].score for r in pii.find_pii(df).collect()}
    assert rows[1] > rows[2]


def test_mask_joins_overlapping_spans(spark):
    got = found(spark, ["x a@1.2.3.4 y", "é😀 +1 (269) 555-3296\n1.2.3.4"])
    assert got[0].masked == "x [EMAIL] y" and got[1].masked == "é😀 [PHONE]\n[IP]"


def test_odd_rows_and_native_plan(spark, odd_docs, no_docs):
    got = pii.find_pii(odd_docs)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, odd_docs.collect()))
    assert pii.find_pii(no_docs).count() == 0
    plan = pii.find_pii(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)
    assert plan.count("regexp_extract_all") == len(pii.KINDS)  # each pattern searched once


def slow_tel(text):
    """Numbers with a context word in the 40 characters before, apart from base spans."""
    kind = next(k for k in pii.KINDS if k.name == "tel")
    base = [tuple(map(int, x.split(":")[1:])) for x in slow_base(text).split(",") if x]
    return [f"tel:{m.start()}:{m.end()}" for m in re.finditer(kind.pattern, text or "")
            if re.search(kind.context, text[max(0, m.start() - 40):m.start()].lower())
            and all(m.end() <= a or b <= m.start() for a, b in base)]


def test_context_reaches_over_earlier_numbers(spark):
    r = random.Random(12)
    parts = ["555-123-4567", "0800 555 1234", "phone", "Tel: ", " ", " or ", ", ", "é", "😀", "some words between ", "a@b.co", "+1 (269) 555-3296", "."]
    texts = ["Phone 555-123-4567 or 555-987-6543", "Phone 555-123-4567, 555-987-6543, 555-987-6544, 555-987-6545",
             "phone" + " " * 40 + "555-123-4567", "phone" + " " * 39 + "555-123-4567 555-123-4568",
             "555-123-4567 " * 511 + "phone 555-123-4567 555-987-6543 555-987-6544 555-987-6545"]
    texts += ["".join(r.choice(parts) for _ in range(r.randint(1, 14))) for _ in range(400)]
    got = found(spark, texts)
    for i, t in enumerate(texts):
        assert [x for x in got[i].all.split(",") if x.startswith("tel:")] == slow_tel(t), t
    assert got[0].masked == "Phone [TEL] or [TEL]"
    assert [len(slow_tel(t)) for t in texts[:5]] == [2, 3, 0, 0, 3]
