import random

import pytest
from pyspark.sql import functions as F

from invoxa.operators.extract import FAMILIES, family_long, with_patterns
from invoxa.operators.paged import document_parts, document_state, family_hits, family_rows
from invoxa.operators.text import document_text

SCHEMA = "doc_id long, filename string, extractor string, page_no int, page_text string"

# What may stand at the foot or the head of a page, or between: labels, separators, values.
BITS = ["Factuurnummer:", "factuur nr", "invoice number", "Betreft: facturen", "ref", "Reference:", "Fact.:", "kvk", "KvK-nummer",
        "btw", "BTW-id", "vat id", "tax", "€", "EUR", "$", "totaal", "bedrag:", "DEMO-CASE-201", "demo-case-7", "NL123456789B01",
        "123456789B01", "12345678", "1234567", "12-05-2024", "3 mei 2024", "2024/05/12", "12", "2024", "1.234,56", "a@b.nl", "x",
        "--- Page 2 ---", "page", ":", "#", "-", "--", ".", "\n", "\n\n", " ", "\u00a0", "\t", "\r\n", "DE", "NL", "B", "B 01", "123 456"]


def text(r, n):
    return "".join(r.choice(BITS) + r.choice(["", " ", "\n", " "]) for _ in range(n))


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(11)
    rows = []
    for doc in range(400):
        for extractor in ("primary", "secondary") if doc % 3 else ("secondary",):
            for no in range(1, r.randint(2, 9)):
                body = r.choice([None, "", " \n ", "123 ", text(r, 2), text(r, 3), text(r, 8)])
                rows.append((doc, f"f{doc}", extractor, no, body))
    rows += [(500, "ties", "primary", 1, t) for t in ("ref: ", "Factuurnummer:\n", "4567", "4567", text(r, 20))]
    rows += [(501, "no number", "primary", None, text(r, 9)), (501, "no number", "primary", 1, "kvk 12345678 " * 9),
             (502, None, "other", 1, "x"), (503, "below", "primary", -1, "ref "), (503, "below", "primary", 0, "DEMO-CASE-1 " * 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("family,block", [*((f, 2) for f in FAMILIES), ("invoice_numbers", 1), ("vat_numbers", 256)])
def test_equals_whole_documents(pages, family, block):
    want = family_long(with_patterns(document_text(pages)), family)
    got = family_rows(pages, family, block)
    assert got.columns == want.columns and got.schema["pos"].dataType == want.schema["pos"].dataType
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block", [1, 256])
def test_state_equals_whole_documents(pages, block):
    want = document_text(pages).drop("text")
    assert sorted(map(str, document_state(pages, block).collect())) == sorted(map(str, want.collect()))


def test_parts_are_the_text(pages):
    whole = {x["doc_id"]: x["text"] for x in document_text(pages).collect()}
    parts = {}
    for x in document_parts(pages, 2).orderBy("doc_id", "block", "page").collect():
        parts[x["doc_id"]] = parts.get(x["doc_id"], "") + x["part"]
    assert parts == {k: v for k, v in whole.items() if v}


def test_hits_that_cross_a_border(spark):
    rows = [(1, "f", "primary", 1, "long enough text for the primary extractor. Factuurnummer:"), (1, "f", "primary", 2, ""),
            (1, "f", "primary", 3, " 98765 and ref"), (1, "f", "primary", 4, "VAT")]
    pages = spark.createDataFrame(rows, SCHEMA)
    assert {x["value"] for x in family_rows(pages, "invoice_numbers", 1).collect()} == {"---", "98765", "Page"}


def test_no_pages(spark, pages):
    none = pages.where("false")
    assert family_rows(none, "dates").collect() == [] and document_state(none).collect() == []


def test_one_document_in_many_tasks(spark):
    """90 % of the pages are one document's; its hits still come from several tasks."""
    rows = (spark.range(4000).select(
        F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.lit(-1)).alias("doc_id"), F.lit("f").alias("filename"),
        F.lit("primary").alias("extractor"), F.col("id").cast("int").alias("page_no"),
        F.concat(F.lit("Datum 3 mei 2024, DEMO-CASE-"), F.col("id").cast("string"), F.lit(" totaal: 12,50 and more text")).alias("page_text")))
    changed = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        hits = family_hits(document_parts(rows, 16), "client_cases").withColumn("task", F.spark_partition_id())
        tasks = hits.where("doc_id = -1").groupBy("task").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(t["count"] for t in tasks) == 3600 and len(tasks) > 2
    pos = family_rows(rows, "client_cases", 16).where("doc_id = -1")
    assert [x["pos"] for x in pos.orderBy("pos").collect()] == list(range(3600))
