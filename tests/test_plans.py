"""Plan-shape guards for the scale properties claimed in the README."""

import re

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


def _plan(spark, name):
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


def test_phase1_adds_no_shuffle_on_document_keys(spark):
    plan = _plan(spark, "doc_verdict")
    keys = re.findall(r"Exchange hashpartitioning\(([a-z_]+)#", plan)
    assert keys, plan
    assert set(keys) <= {"l_orderkey", "o_orderkey", "code", "canon", "_exact_code"}, keys
    # the registry lookups are under Spark's own byte threshold
    assert plan.count("BroadcastHashJoin") >= 2


def test_large_registry_is_not_broadcast(spark):
    small = {tuple(r) for r in queries()["doc_verdict"](spark, SF).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = queries()["doc_verdict"](spark, SF)
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in df.collect()} == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_recovery_and_allow_list_run_once(spark):
    final = _plan(spark, "final_results")
    dropped = _plan(spark, "dropped_codes")
    assert final.count("regexp_extract_all") <= 27, final.count("regexp_extract_all")
    for node in ("Scan parquet", "Exchange "):
        assert dropped.count(node) <= final.count(node), node


def test_extraction_not_duplicated_by_inferred_filters(spark):
    plan = _plan(spark, "extract_amounts")
    # one amount-family projection: four amount patterns, each applied once
    assert plan.count("regexp_extract_all") == 4, plan


def test_recovery_prompts_run_the_header_patterns_once(spark):
    # 12 for phase 1's codes and kvk, vat, number and date, as in final_results
    assert _plan(spark, "recovery_prompts").count("regexp_extract_all") <= _plan(spark, "final_results").count("regexp_extract_all")


def test_verdict_gathers_no_match_records(spark):
    # counts decide it; the lists of codes, records and contexts are not asked for
    for name in ("doc_confidence", "manifest_rows"):
        assert "collect_list(struct(case_pos" not in _plan(spark, name), name
    assert "collect_list(struct(case_pos" in _plan(spark, "metadata_matches")


def test_each_pattern_runs_once_for_all_lists(spark):
    from invoxa.functions.patterns import PATTERN_FAMILIES
    from invoxa.operators.extract import with_patterns
    texts = spark.range(1).selectExpr("cast(id as string) as text").repartition(2)
    plan = with_patterns(texts).select("patterns")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == sum(map(len, PATTERN_FAMILIES.values())), plan


def test_line_texts_are_made_before_the_shuffle(spark):
    plan = _plan(spark, "text_fallback")
    lambdas = re.findall(r"lambdafunction\(.*", plan)
    assert lambdas and not any("round(" in x or "lpad(" in x for x in lambdas), lambdas
