"""Model-response resolution: attempts, schema checks, OCR tiers, post-processing."""

from pyspark.sql import functions as F

from conftest import one
from invoxa.functions.jsonish import parse_header, parse_lines
from invoxa.operators.responses import (apply_corrections, classify_attempts, enforce_allowed,
                                        recover_header, resolve_attempts, split_no_activity)

X = F.col("x")
H = '{"invoiceHeader": {"supplierName": "S", "kvkNumber": "12345678"}, "isCoachingInvoice": true}'


def test_header_schema_strictness(spark):
    assert one(spark, parse_header(X), H) is not None
    assert one(spark, parse_header(X), "Sure: ```json\n" + H + "\n```") is not None
    bad_type = '{"invoiceHeader": {"invoiceNumber": 2022}, "isCoachingInvoice": true}'
    assert one(spark, parse_header(X), bad_type) is None
    assert one(spark, parse_header(X), '{"invoiceHeader": null, "isCoachingInvoice": true}') is None
    assert one(spark, parse_header(X), '{"invoiceHeader": {}}') is None
    lax = one(spark, parse_header(X), '{"invoiceHeader": {}, "isCoachingInvoice": "yes", "x": 1}')
    assert lax.isCoachingInvoice is True
    assert one(spark, parse_header(X), "not json") is None


def test_lines_schema(spark):
    ok = one(spark, parse_lines(X), '{"clientCases": [{"validatedClientCaseNumber": "A", '
                                   '"durationHours": "1.5"}]}')
    assert ok.clientCases[0].durationHours == 1.5 and ok.clientCasesNoActivity == []
    assert one(spark, parse_lines(X), '{}').clientCases == []
    assert one(spark, parse_lines(X), '{"clientCases": null}') is None
    assert one(spark, parse_lines(X), '{"clientCases": [{"date": "x"}]}') is None
    assert one(spark, parse_lines(X), '{"clientCasesNoActivity": [1]}') is None


def _resolve(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, agent string, attempt int, "
                                     "response_text string, error string")
    r = resolve_attempts(classify_attempts(df)).orderBy("doc_id").collect()
    return {x.doc_id: x.header_res is not None for x in r}


def test_attempt_walk(spark):
    o = "503 UNAVAILABLE"
    rows = [
        (1, "header", 0, None, o), (1, "header", 1, H, None),                      # retry then ok
        (2, "header", 0, None, "400 bad"), (2, "header", 1, H, None),              # stop
        (3, "header", 0, None, o), (3, "header", 1, None, o), (3, "header", 2, None, "429"),
        (3, "header", 3, None, o), (3, "header", 4, H, None),                      # budget spent
        (4, "header", 0, "", None),                                                 # empty answer
        (5, "header", 1, H, None),                                                  # gap at 0
        (6, "header", 0, "{bad", None), (6, "header", 1, H, None),                # invalid stops
    ]
    assert _resolve(spark, rows) == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


HDR_T = ("struct<invoiceHeader:struct<supplierName:string,invoiceNumber:string,invoiceDate:string,"
         "kvkNumber:string,vatNumber:string>,isCoachingInvoice:boolean>")


def _recover(spark, kvk, vat, ocr, rec_kvk, rec_vat):
    df = spark.createDataFrame([(kvk, vat, ocr, rec_kvk, rec_vat)],
                               "kvk string, vat string, ocr string, rk string, rv string")
    h = F.struct(F.struct(*[F.lit(None).cast("string").alias(f) for f in
                            ("supplierName", "invoiceNumber", "invoiceDate")],
                          F.col("kvk").alias("kvkNumber"), F.col("vat").alias("vatNumber"))
                 .alias("invoiceHeader"), F.lit(True).alias("isCoachingInvoice"))
    rec = F.when(F.col("rk").isNotNull() | F.col("rv").isNotNull(), F.struct(
        F.struct(*[F.lit(None).cast("string").alias(f) for f in
                   ("supplierName", "invoiceNumber", "invoiceDate")],
                 F.col("rk").alias("kvkNumber"), F.col("rv").alias("vatNumber"))
        .alias("invoiceHeader"), F.lit(True).alias("isCoachingInvoice")))
    r = df.select(recover_header(h, F.col("ocr"), rec).alias("r")).first().r
    return r.invoiceHeader.kvkNumber, r.invoiceHeader.vatNumber


def test_ocr_tiers(spark):
    # tier 1 fills only what is missing; both found -> no tier 2
    assert _recover(spark, "", "NL1", "KvK: 12345678\nBTW nr: NL123456789B01", "9", "9") == \
        ("12345678", "NL1")
    # tier 2 overwrites both fields, also the one that was present
    assert _recover(spark, "11111111", None, "KvK: 12345678", "22222222", "NL999999999B01") == \
        ("22222222", "NL999999999B01")
    # no OCR text -> nothing happens
    assert _recover(spark, None, None, "", "2", "3") == (None, None)
    # nothing missing -> OCR ignored
    assert _recover(spark, "1", "2", "KvK: 12345678", "3", "4") == ("1", "2")


def test_split_corrections_allow_list(spark):
    df = spark.createDataFrame([(
        {"clientCases": [{"validatedClientCaseNumber": "DEM0-A", "rawClientCaseNumber": "x",
                          "date": None, "durationHours": 1.0},
                         {"validatedClientCaseNumber": "B", "rawClientCaseNumber": None,
                          "date": None, "durationHours": 0.0},
                         {"validatedClientCaseNumber": "Z", "rawClientCaseNumber": None,
                          "date": None, "durationHours": 2.0}],
         "clientCasesNoActivity": ["C", "DEM0-A"]},
        {"DEM0-A": "DEMO-A", "B": "B"}, ["DEMO-A", "B", "C"])],
        "l struct<clientCases:array<struct<validatedClientCaseNumber:string,rawClientCaseNumber:"
        "string,date:string,durationHours:double>>,clientCasesNoActivity:array<string>>, "
        "m map<string,string>, a array<string>")
    s = split_no_activity(F.col("l"))
    cases, na = apply_corrections(s["clientCases"], s["clientCasesNoActivity"], F.col("m"))
    kept, kept_na = enforce_allowed(cases, na, F.col("a"))
    r = df.select(s.alias("s"), cases.alias("c"), na.alias("na"), kept.alias("k"),
                  kept_na.alias("kna")).first()
    assert r.s.clientCasesNoActivity == ["B", "C", "DEM0-A"]
    assert [(c.validatedClientCaseNumber, c.rawClientCaseNumber) for c in r.c] == \
        [("DEMO-A", "DEM0-A"), ("Z", None)]
    assert r.na == ["B", "C", "DEMO-A"]
    assert [c.validatedClientCaseNumber for c in r.k] == ["DEMO-A"]
    assert r.kna == ["B", "C", "DEMO-A"]
    empty = df.select(split_no_activity(F.lit(None).cast(df.schema["l"].dataType)).alias("e")).first()
    assert empty.e.clientCases == [] and empty.e.clientCasesNoActivity == []


def test_failed_header_that_quotes_an_overload_code_is_retried(spark):
    from invoxa.operators.responses import classify_attempts, resolve_attempts
    def header(number):
        return '{"invoiceHeader": {"invoiceNumber": %s}, "isCoachingInvoice": true}' % number
    rows = [(1, "header", 0, header("150371"), None), (1, "header", 1, header('"good"'), None),
            (2, "header", 0, header("150271"), None), (2, "header", 1, header('"late"'), None),
            (3, "header", 0, header('"503"'), None), (4, "header_recovery", 0, header("429"), None),
            (5, "header", 0, '{"invoiceHeader": null}', None), (6, "header", 0, "503 {", None)]
    df = spark.createDataFrame(rows, "doc_id long, agent string, attempt int, response_text string, error string")
    found = classify_attempts(df)
    cls = {(r.doc_id, r.attempt): r.cls for r in found.collect()}
    assert [cls[k] for k in sorted(cls)] == ["retry", "ok", "stop", "ok", "ok", "retry", "stop", "retry"]
    number = {r.doc_id: r.header_res and r.header_res.invoiceHeader.invoiceNumber for r in resolve_attempts(found).collect()}
    assert number == {1: "good", 2: None, 3: "503", 4: None, 5: None, 6: None}
