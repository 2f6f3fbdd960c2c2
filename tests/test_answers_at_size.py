"""Answers are read by steps whose cost stays low on long answers: plan guards and odd answers."""

import re

import pytest
from pyspark.sql import functions as F

from invoxa.functions.jsonish import carve_json, is_array, is_object, item_facts, lines_from_variant, parse_response
from invoxa.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["validate_lines", "validate_line_items"])
def test_answers_are_not_reversed_nor_copied_for_a_type_test(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "reverse(" not in plan and "MapType(StringType" not in plan and "map<string,variant>" not in plan


def test_carving_and_shapes_of_odd_answers(spark):
    rows = [("a } b", "a } b"), ("} {", ""), ("x {1} é} tail 🙂 y", "{1} é}"), ("{🙂}🙂", "{🙂}"), ("plain", "plain"),
            ("{ only", "{ only"), ("}", "}"), (None, None), ("", ""), ("```json\n[1]\n``` more", "[1]")]
    df = spark.createDataFrame(rows, "text string, want string")
    got = df.select("text", "want", carve_json(F.col("text")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    shapes = [("{}", True, False), ('{"a": [1]}', True, False), ("[]", False, True), ("[1, {}, null]", False, True),
              ("null", False, False), ('"{}"', False, False), ("7", False, False)]
    v = spark.createDataFrame(shapes, "t string, o boolean, a boolean").withColumn("v", F.parse_json("t"))
    assert all((r.o, r.a) == (r.go, r.ga) for r in v.select("o", "a", is_object(F.col("v")).alias("go"), is_array(F.col("v")).alias("ga")).collect())


def test_lists_absent_null_and_of_other_types(spark):
    good = '{"validatedClientCaseNumber": "A", "rawClientCaseNumber": null, "date": "d", "durationHours": "1.5", "more": {"x": [1]}}'
    rows = [("{}", 0), ('{"clientCases": null}', None), ('{"clientCases": {}}', None), ('{"clientCases": [1]}', None),
            ('{"clientCases": [null]}', None), (f'{{"clientCases": [{good}, {good}]}}', 2), ('{"clientCases": [{}]}', None),
            ('{"clientCases": [{"validatedClientCaseNumber": 5}]}', None), ('{"clientCasesNoActivity": null}', None),
            ('{"clientCasesNoActivity": ["a", 1]}', None), ('{"clientCasesNoActivity": ["a"], "clientCases": []}', 0), ("[]", None),
            ('{"clientCases": [{"validatedClientCaseNumber": "A", "durationHours": {}}]}', None),
            ('{"clientCases": [{"validatedClientCaseNumber": "A", "date": []}]}', None)]
    df = spark.createDataFrame(rows, "text string, want int").withColumn("v", parse_response(F.col("text"), lines=True))
    df = df.withColumn("facts", item_facts(F.col("v")))
    x = lines_from_variant(F.col("v"), F.col("facts"))
    got = df.select("text", "want", F.when(x.isNotNull(), F.size(x["clientCases"])).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


def test_final_results_search_the_codes_once(spark):
    """The count of codes tells a coaching invoice; the texts are not searched again for it."""
    plan = _plan(QUERIES["final_results"](spark, SF))
    assert plan.count("CASE-[A-Z0-9-]+") == 1


@pytest.mark.parametrize("name", ["resolve_attempts", "assemble_text"])
def test_texts_are_built_below_the_generators(spark, name):
    generators = re.findall(r"Generate explode\(.*?, false, \[", _plan(QUERIES[name](spark, SF)), re.S)
    assert generators and not any("transform(" in g for g in generators)
