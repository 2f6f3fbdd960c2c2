"""File sources/sinks round trips and the streaming extraction."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from invoxa.operators.matching import ref_codes
from invoxa.sources import files
from invoxa.streaming import document_stream, extract_stream


def test_registry_csv_crlf(spark):
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    p = os.path.join(d, "reg.csv")
    with open(p, "wb") as f:
        f.write(b"clientCaseNumber\r\nDEMO-CASE-201\r\n  DEMO-CASE-010 \r\n\r\n")
    codes = sorted(r.code for r in ref_codes(files.read_registry_csv(spark, p)).collect())
    assert codes == ["DEMO-CASE-010", "DEMO-CASE-201"]


def test_truth_manifest_metadata_raw_text(spark):
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    truth = {"invoiceHeader": {"supplierName": "S", "invoiceNumber": None, "invoiceDate": "2025-01-01",
                               "kvkNumber": "1", "vatNumber": None},
             "isCoachingInvoice": True,
             "clientCases": [{"validatedClientCaseNumber": "A", "rawClientCaseNumber": "A",
                              "date": "2025-01-01", "durationHours": 1.0}],
             "clientCasesNoActivity": ["B"]}
    os.makedirs(os.path.join(d, "truth"))
    with open(os.path.join(d, "truth", "inv 1.json"), "w") as f:
        json.dump(truth, f, indent=2)
    t = files.read_json_results(spark, os.path.join(d, "truth")).first()
    assert t.filename == "inv 1.json" and t.clientCases[0].durationHours == 1.0
    manifest = {"total_invoices": 2, "processing_date": "x", "invoices": [
        {"filename": "a.pdf", "confidence": 0.9, "is_coaching_invoice": True,
         "client_case_verdict": "accept", "client_case_reason": "r", "ready_for_llm": True},
        {"filename": "b.pdf", "confidence": 0.1, "is_coaching_invoice": False,
         "client_case_verdict": "reject", "client_case_reason": "r", "ready_for_llm": False}]}
    with open(os.path.join(d, "manifest.json"), "w") as f:
        json.dump(manifest, f, indent=2)
    meta = {"a.pdf": {"text_length": 5, "kvk": "1", "patterns_found": {
        "client_case_matches": {"X": {"matchedCode": "Y", "matchStatus": "fuzzy_io_swap",
                                      "matchConfidence": 0.75, "contamination": "none",
                                      "candidates": ["Y"], "notes": None}}}}}
    with open(os.path.join(d, "meta.json"), "w") as f:
        json.dump(meta, f, indent=2)
    os.makedirs(os.path.join(d, "raw"))
    with open(os.path.join(d, "raw", "a_raw.txt"), "w") as f:
        f.write("line1\nline2")
    m = files.read_manifest(spark, os.path.join(d, "manifest.json"))
    md = files.read_metadata(spark, os.path.join(d, "meta.json"))
    rt = files.read_raw_texts(spark, os.path.join(d, "raw"))
    w = files.work_list_from_files(m, md, rt).collect()
    assert [r.filename for r in w] == ["a.pdf"] and w[0].raw_text == "line1\nline2"
    assert w[0].patterns_found.client_case_matches["X"].matchedCode == "Y"
    assert (w[0].allowed_prompt, w[0].allowed_valid, w[0].correction_map) == (["X"], ["Y"], {"X": "Y"})


def test_context_leaves_out_unmatched_codes(spark):
    from invoxa.operators.matching import context_from_map
    kind = f"map<string,{files.MATCH}>"
    rows = ['{"B": {"matchStatus": "exact", "matchedCode": "B"}, "Q": {"matchStatus": "unknown"}, '
            '"A": {"matchStatus": "fuzzy_io_swap", "matchedCode": "B"}, "E": {"matchStatus": "exact"}}', "{}", None]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.from_json("j", kind).alias("m"))
    prompt, valid, corrections = context_from_map(F.col("m"))
    got = df.select(prompt.alias("p"), valid.alias("v"), corrections.alias("c")).collect()
    assert [tuple(r) for r in got] == [(["B", "A"], ["B", "B"], {"B": "B", "A": "B"}), ([], [], {}), ([], [], {})]


def test_documents_are_listed_by_name_and_raw_texts_read_back(spark):
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    for name in ("c.pdf", "a.pdf", "b.txt", "b.pdf"):
        with open(os.path.join(d, name), "w") as f:
            f.write("x" * len(name))
    assert [(r.filename, r.size) for r in files.list_documents(spark, d).collect()] == [
        ("a.pdf", 5), ("b.pdf", 5), ("c.pdf", 5)]
    docs = spark.createDataFrame([("a.pdf", "one"), ("b c.pdf", None)], "filename string, text string")
    files.write_raw_texts(docs, os.path.join(d, "raw"), "now")
    back = {r.filename: r.raw_text for r in files.read_raw_text_table(spark, os.path.join(d, "raw")).collect()}
    assert sorted(back) == ["a.pdf", "b c.pdf"] and back["a.pdf"].endswith("\n\none") and "Source: b c.pdf\n" in back["b c.pdf"]


def test_results_sink_keeps_nulls(spark):
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    df = spark.createDataFrame([("a.pdf", None)], "filename string, x string")
    files.write_json_lines(df, os.path.join(d, "out"))
    lines = [l for f in os.listdir(os.path.join(d, "out")) if f.endswith(".json")
             for l in open(os.path.join(d, "out", f))]
    assert json.loads(lines[0]) == {"filename": "a.pdf", "x": None}


def test_written_results_read_back(spark):
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    df = (spark.range(200).select(F.format_string("inv_%d.pdf", "id").alias("filename"),
          F.expr(f"from_json('{{}}', '{files.TRUTH_SCHEMA}')").alias("x")).select("filename", "x.*")
          .withColumn("isCoachingInvoice", F.lit(True))).repartition(3)
    files.write_results(df, os.path.join(d, "out"))
    back = files.read_result_lines(spark, os.path.join(d, "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_written_manifest_and_metadata_read_back(spark):
    from invoxa.operators.documents import manifest_rows, metadata_record
    from invoxa.plans.pipeline import phase1_from
    d = tempfile.mkdtemp(prefix="invoxa-test-")
    docs = phase1_from(spark, "/root/testdata/sf0.001").where("doc_id < 400")
    files.write_manifest(manifest_rows(docs), os.path.join(d, "m"))
    files.write_metadata(metadata_record(docs), os.path.join(d, "md"))
    key = lambda r: r.filename
    want = sorted(metadata_record(docs).collect(), key=key)
    got = sorted(files.read_metadata_lines(spark, os.path.join(d, "md")).collect(), key=key)
    assert [r.filename for r in got] == [r.filename for r in want] and len(got) > 10
    for a, b in zip(got, want):
        assert a.client_case_summary.verdict == b.client_case_summary.verdict
        if b.patterns_found is not None:
            assert a.patterns_found.asDict(True) == b.patterns_found.asDict(True)
    entries = files.read_manifest_lines(spark, os.path.join(d, "m"))
    assert sorted(map(str, entries.collect())) == sorted(map(str, manifest_rows(docs).drop("doc_id").collect()))


def test_long_document_keys_keep_their_names(spark):
    from invoxa.sources.fixtures import filename_of
    keys = spark.createDataFrame([(7,), (123456780,), (123456781,)], "doc_id long")
    assert [r[0] for r in keys.select(filename_of(F.col("doc_id"))).collect()] == [
        "inv_00000007.pdf", "inv_123456780.pdf", "inv_123456781.pdf"]


def test_streaming_extraction(spark):
    src = "/root/testdata/sf0.001"
    q = (extract_stream(document_stream(spark, src, glob="documents.parquet"))
         .writeStream.format("memory").queryName("doc_hits").outputMode("append").start())
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    n = spark.sql("SELECT count(*) AS n FROM doc_hits").first().n
    assert n == spark.read.parquet(f"{src}/documents.parquet").count()


def test_metadata_lines_take_little_room(spark, tmp_path):
    """Names and values repeat from line to line: the written lines are packed."""
    from invoxa.operators import documents as D
    from invoxa.plans.pipeline import phase1_from
    from invoxa.sources import files
    docs = phase1_from(spark, "/root/testdata/sf0.001")
    meta = D.metadata_record(docs)
    files.write_metadata(meta, str(tmp_path / "m"))
    written = sum(f.stat().st_size for f in (tmp_path / "m").iterdir())
    rows = files.read_metadata_lines(spark, str(tmp_path / "m"))
    assert rows.count() == meta.count() and written < 700 * rows.count()
