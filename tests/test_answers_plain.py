"""Answers of the plain form are read at once, with the results of the whole check; phase 2
alone puts the pages together once."""

from pyspark.sql import functions as F

from conftest import one
from invoxa.functions.jsonish import (list_of_answer, parse_header, parse_lines, plain_header, plain_lines,
                                      plain_lines_result)
from invoxa.operators.text import MIN_USABLE_CHARS, text_ok
from invoxa.plans.pipeline import derived_inputs, phase1, phase1_coded, work_list
from invoxa.plans.queries import QUERIES

X = F.col("x")
SF = "/root/testdata/sf0.001"
HEADERS = {  # answer: whether it is of the plain form
    '{"invoiceHeader": {"supplierName": "S", "kvkNumber": null}, "isCoachingInvoice": true}': True,
    '{"invoiceHeader": {}, "isCoachingInvoice": false}': True,
    '{"invoiceHeader": {"supplierName": 1}, "isCoachingInvoice": true}': False,
    '{"invoiceHeader": {"other": "S"}, "isCoachingInvoice": true}': False,
    '{"invoiceHeader": {}, "isCoachingInvoice": "yes"}': False,
    '{"invoiceHeader": {}, "isCoachingInvoice": true}, null': False,
    '{"invoiceHeader": {"vatNumber": "a", "vatNumber": "b"}, "isCoachingInvoice": true}': False,
    '{"invoiceHeader": null, "isCoachingInvoice": true}': False,
}
ITEM = '{"validatedClientCaseNumber": "A", "date": null, "durationHours": %s}'
LINES = {
    '{"clientCases": [%s, %s]}' % (ITEM % "1", ITEM % "1.5"): True,
    '{"clientCases": [], "clientCasesNoActivity": ["a"]}': True,
    '{}': True,
    '{"clientCases": [%s, null]}' % (ITEM % "1"): False,
    '{"clientCases": [%s, {"date": "x"}]}' % (ITEM % "1"): False,
    '{"clientCases": [%s]}' % (ITEM % '"1.5"'): False,
    '{"clientCases": [%s, %s]}' % (ITEM % "1", ITEM % "true"): False,
    '{"clientCases": [], "clientCasesNoActivity": ["a", null]}': False,
    '{"clientCases": null}': False,
    '{"clientCases": []}, {"clientCases": []}': False,
}


def test_plain_answers_are_read_as_checked(spark):
    for text, plain in HEADERS.items():
        read = spark.createDataFrame([(text,)], "x string").withColumn("x", list_of_answer(X)).select(plain_header(X)).first()[0]
        assert (read is not None) == plain, text
        assert not plain or read == one(spark, parse_header(X), text), text
    for text, plain in LINES.items():
        listed = spark.createDataFrame([(text,)], "x string").withColumn("x", list_of_answer(X))
        read = listed.withColumn("r", plain_lines(X)).select(plain_lines_result(F.col("r"))).first()[0]
        assert (read is not None) == plain, text
        assert not plain or read == one(spark, parse_lines(X), text), text


def test_usable_text_counts_between_the_ends(spark):
    n = MIN_USABLE_CHARS
    for text, ok in (("a" * n, False), ("a" * (n + 1), True), (" \n" + "a" * n + "　", False), ("a" + "\n" * (n - 1) + "b", True),
                     ("a" + " " * n * 9, False), (" " + "\U0001f600" * (n + 1), True), ("\U0001f600" * n, False), ("", False), (None, False)):
        assert one(spark, text_ok(X), text) is ok, repr(text)


def test_phase_two_alone_assembles_pages_once(spark):
    for name in ("results_rollup", "final_results", "eval_by_field", "eval_case_diff", "eval_fields"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list(struct(extractor") == 1, name


def test_coded_documents_make_the_same_work_list(spark):
    inp = derived_inputs(spark, SF)
    names = ("doc_id", "filename", "text_length", "matches", "client_case_summary", "allowed_prompt", "allowed_valid", "correction_map")
    whole, coded = (work_list(f(inp.pages, inp.registry)).select(*names).orderBy("doc_id").collect() for f in (phase1, phase1_coded))
    assert whole == coded and len(whole) > 100
