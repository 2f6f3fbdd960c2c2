"""One file per document, one-object files read in parts, and the registry in file order."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from invoxa.operators.matching import FILE_ORDER, ref_canon, ref_codes
from invoxa.sources import files
from invoxa.sources.document_files import write_document_files


def folder():
    return tempfile.mkdtemp(prefix="invoxa-test-")


def written(path, data, **layout):
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(data if isinstance(data, str) else json.dumps(data, **layout))
    return path


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def entries(n):
    odd = ["a \"quoted\" }\n    }, {", "\\", "é }\n  },\n", "", "{"]
    return [{"filename": f"inv {i} {odd[i % 5]}.pdf", "confidence": i / 7, "is_coaching_invoice": i % 2 == 0,
             "client_case_verdict": odd[i % 5], "client_case_reason": None, "ready_for_llm": True} for i in range(n)]


def rows(df):
    return sorted(map(str, df.collect()))


def test_manifest_in_parts(spark, small_blocks):
    path = written(os.path.join(folder(), "m.json"), {"total_invoices": 3000, "processing_date": "x", "invoices": entries(3000)},
                   indent=2)
    parts = files.read_manifest_parts(spark, path)
    assert parts.rdd.getNumPartitions() > 10
    assert rows(parts) == rows(files.read_manifest(spark, path)) and parts.count() == 3000


def test_metadata_in_parts(spark, small_blocks):
    meta = {e["filename"]: {"text_length": i, "kvk": e["client_case_verdict"], "patterns_found": {
        "client_cases": ["}", "\n  }"], "amounts": [], "client_case_matches": {"X": {"matchedCode": "Y"}}}} if i % 9 else {}
        for i, e in enumerate(entries(2000))}
    meta["last.pdf"] = {}
    path = written(os.path.join(folder(), "m.json"), meta, indent=2, ensure_ascii=False)
    parts = files.read_metadata_parts(spark, path)
    assert parts.rdd.getNumPartitions() > 10
    assert rows(parts) == rows(files.read_metadata(spark, path)) and parts.count() == 2001


@pytest.mark.parametrize("n", [0, 1, 2])
def test_parts_of_short_files(spark, n):
    d = folder()
    m = written(os.path.join(d, "m.json"), {"invoices": entries(n), "total_invoices": n}, indent=2)
    assert rows(files.read_manifest_parts(spark, m)) == rows(files.read_manifest(spark, m))
    k = written(os.path.join(d, "k.json"), {e["filename"]: {"kvk": "1"} for e in entries(n)}, indent=2)
    assert rows(files.read_metadata_parts(spark, k)) == rows(files.read_metadata(spark, k))


def test_parts_of_other_layouts_are_refused_or_whole(spark):
    d = folder()
    for i, layout in enumerate(({}, {"indent": 4}, {"indent": 1})):
        m = written(os.path.join(d, f"m{i}.json"), {"total_invoices": 2, "invoices": entries(2)}, **layout)
        with pytest.raises(Exception, match="not a file of one object"):
            files.read_manifest_parts(spark, m).collect()
    nested = {"a.pdf": {"kvk": "1", "patterns_found": {"client_cases": ["x"]}}, "b.pdf": {"kvk": "2"}}
    for i, layout in enumerate(({}, {"indent": 4})):
        k = written(os.path.join(d, f"k{i}.json"), nested, **layout)
        assert rows(files.read_metadata_parts(spark, k)) == rows(files.read_metadata(spark, k))
    with pytest.raises(Exception, match="not a file of one object"):
        files.read_metadata_parts(spark, written(os.path.join(d, "k9.json"), nested, indent=1)).collect()


def test_results_and_texts_one_file_per_document(spark):
    d = folder()
    df = (spark.range(40).select(F.format_string("inv é %d.pdf", "id").alias("filename"), F.lit("t").alias("text"),
          F.expr(f"from_json('{{}}', '{files.TRUTH_SCHEMA}')").alias("x")).select("filename", "text", "x.*")
          .withColumn("isCoachingInvoice", F.lit(True))).repartition(3)
    files.write_result_files(df, os.path.join(d, "out"))
    assert sorted(os.listdir(os.path.join(d, "out"))) == sorted(f"inv é {i}_parsed.json" for i in range(40))
    back = files.read_json_results(spark, os.path.join(d, "out"))
    name = F.replace("filename", F.lit("_parsed.json"), F.lit(".pdf"))
    assert rows(back.withColumn("filename", name)) == rows(df.drop("text"))
    text = json.load(open(os.path.join(d, "out", "inv é 7_parsed.json"), encoding="utf-8"))
    assert text == {"invoiceHeader": None, "isCoachingInvoice": True, "clientCases": None, "clientCasesNoActivity": None}

    files.write_raw_text_files(df, os.path.join(d, "raw"), "now")
    got = {r.filename: r.raw_text for r in files.read_raw_texts(spark, os.path.join(d, "raw")).collect()}
    assert len(got) == 40 and got["inv é 3.pdf"].endswith("\n\nt")
    ocr = spark.createDataFrame([("a.pdf", "one\n"), ("b.pdf", ""), ("c.pdf", None)], "filename string, text string")
    files.write_ocr_text_files(ocr, os.path.join(d, "ocr"))
    back = files.read_raw_texts(spark, os.path.join(d, "ocr"), suffix="_ocr.txt").select("filename", "raw_text").collect()
    assert [tuple(r) for r in back] == [("a.pdf", "one\n")]


def test_failed_write_leaves_nothing_and_files_are_replaced(spark):
    d = os.path.join(folder(), "out")
    name, content = F.concat(F.col("id"), F.lit(".txt")), F.col("id")
    bad = F.when(F.col("id") == 37, F.raise_error(F.lit("stop")).cast("string")).otherwise(name)
    with pytest.raises(Exception, match="stop"):
        write_document_files(spark.range(0, 40, 1, 4), d, bad, content)
    assert not os.path.isdir(d) or os.listdir(d) == []
    write_document_files(spark.range(0, 40, 1, 4), d, name, content)
    write_document_files(spark.range(5), "file:" + d, name, F.lit("new"))
    write_document_files(spark.range(0), d, name, content)
    assert sorted(os.listdir(d)) == sorted(f"{i}.txt" for i in range(40))
    assert [open(os.path.join(d, f"{i}.txt")).read() for i in (4, 5)] == ["new", "5"]
    for wrong in (None, "", "..", "a/b"):
        with pytest.raises(Exception, match="not the name of a file"):
            write_document_files(spark.range(1), d, F.lit(wrong), content)
    assert len(os.listdir(d)) == 40


def test_registry_keeps_file_order_over_blocks(spark, small_blocks):
    codes = [f"DEMO-CASE-{'I' if (i * 7) % 3 else '1'}{i % 90:02d}" for i in range(6000)]
    path = written(os.path.join(folder(), "r.csv"), "x,clientCaseNumber\r\n" + "".join(f"{i}, {c} \r\n" for i, c in enumerate(codes)))
    registry = files.read_registry_csv(spark, path)
    assert registry.rdd.getNumPartitions() > 3
    want = {}
    for c in codes:
        want.setdefault(c.replace("DEMO-CASE-I", "DEM0-CASE-1").replace("DEMO", "DEM0"), []).append(c)
    got = {r.canon: r for r in ref_canon(ref_codes(registry)).collect()}
    assert {k: r.candidates for k, r in got.items()} == want
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in want.items()}
    unordered = ref_canon(ref_codes(registry.drop(FILE_ORDER)))
    assert {r.canon: r.candidates for r in unordered.collect()} == {k: sorted(v) for k, v in want.items()}
    empty = ref_canon(ref_codes(registry.limit(0)))
    assert empty.collect() == []
