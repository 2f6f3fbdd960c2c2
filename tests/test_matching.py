"""Registry matching, verdicts and confidence."""

from pyspark.sql import functions as F

from invoxa.operators.documents import confidence
from invoxa.operators.extract import with_patterns
from invoxa.operators.matching import (annotate_documents, lookup_tables, match_codes,
                                       ref_codes)

REG = ["DEMO-CASE-201", "DEMO-CASE-110", "DEMO-CASE-I10", "DEMO-CASE-300", "  ", "DEMO-CASE-300"]


def lookups(spark, reg=REG):
    return lookup_tables(ref_codes(spark.createDataFrame([(c,) for c in reg], "clientCaseNumber string")))


def match(spark, codes, reg=REG):
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    return {r.code: r.m.asDict() for r in match_codes(df, "code", lookups(spark, reg), "m").collect()}


def test_statuses(spark):
    m = match(spark, ["DEMO-CASE-201", "DEM0-CASE-201", "demo-case-201", "DEM0-CASE-110",
                      "DEMO-CASE-999", " "])
    assert m["DEMO-CASE-201"]["matchStatus"] == "exact"
    assert m["DEMO-CASE-201"]["candidates"] == ["DEMO-CASE-201"]
    assert m["DEMO-CASE-201"]["contamination"] == "O_only"
    assert m["DEM0-CASE-201"]["matchStatus"] == "fuzzy_io_swap"
    assert m["DEM0-CASE-201"]["matchedCode"] == "DEMO-CASE-201"
    assert m["DEM0-CASE-201"]["matchConfidence"] == 0.75
    assert m["demo-case-201"]["matchStatus"] == "fuzzy_io_swap"
    assert m["DEM0-CASE-110"]["matchStatus"] == "ambiguous_io_swap"
    assert m["DEM0-CASE-110"]["candidates"] == ["DEMO-CASE-110", "DEMO-CASE-I10"]
    assert m["DEM0-CASE-110"]["matchedCode"] is None
    assert m["DEMO-CASE-999"]["matchStatus"] == "unknown"
    assert m["DEMO-CASE-999"]["notes"] == "clientCaseNumber is not registered"
    assert m[" "]["notes"] == "Empty or whitespace-only clientCaseNumber"


def test_duplicate_registry_rows_make_fuzzy_ambiguous(spark):
    m = match(spark, ["DEM0-CASE-300", "DEMO-CASE-300"])
    assert m["DEM0-CASE-300"]["matchStatus"] == "ambiguous_io_swap"
    assert m["DEMO-CASE-300"]["matchStatus"] == "exact"


def test_registry_first_column_fallback(spark):
    reg = spark.createDataFrame([("DEMO-CASE-001", "x")], "code string, other string")
    assert ref_codes(reg).collect()[0].code == "DEMO-CASE-001"


def _docs(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return with_patterns(df.withColumn("text_length", F.length("text")))


def test_verdicts_and_counts(spark):
    texts = ["DEMO-CASE-201", "DEM0-CASE-201", "DEMO-CASE-201 DEMO-CASE-999", "no codes", "",
             "DEM0-CASE-110"]
    a = annotate_documents(_docs(spark, texts), lookups(spark)).orderBy("doc_id").collect()
    v = [r.client_case_summary.verdict for r in a]
    assert v == ["accept", "needs_review", "reject", "reject", "reject", "reject"]
    c = a[2].client_case_summary.counts.asDict()
    assert c == {"exact": 1, "fuzzy_io_swap": 0, "unknown": 1, "ambiguous_io_swap": 0}
    assert sum(a[1].client_case_summary.counts.asDict().values()) == 1
    assert a[1].correction_map == {"DEM0-CASE-201": "DEMO-CASE-201"}
    assert a[1].allowed_prompt == ["DEM0-CASE-201"] and a[1].allowed_valid == ["DEMO-CASE-201"]


def test_missing_registry_rejects_everything(spark):
    a = annotate_documents(_docs(spark, ["DEMO-CASE-201"]), None).collect()
    assert a[0].client_case_summary.verdict == "reject"
    assert a[0].matches == []


def test_confidence_literals(spark):
    df = spark.createDataFrame([
        (True, ["d"], [1.0], ["n"], 600), (False, [], [], [], 10), (False, [], [], [], 0),
        (True, ["d"], [1.0], [], 101)],
        "c boolean, dates array<string>, amounts array<double>, inv array<string>, n int")
    p = F.struct(F.col("dates").alias("dates"), F.col("amounts").alias("amounts"),
                 F.col("inv").alias("invoice_numbers"))
    r = [x[0] for x in df.select(confidence(F.col("c"), p, F.col("n"))).collect()]
    assert r == [1.0, 0.1, 0.0, 0.8500000000000001]
