"""Hand-offs between phases: buckets, observed totals, and codes matched by a dictionary."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from invoxa.operators.matching import HEAVY_CODES, lookup_tables, match_codes, match_codes_once, ref_codes
from invoxa.operators.responses import ocr_tier
from invoxa.plans.pipeline import derived_inputs, phase2, run_phases
from invoxa.session import materialize, materialize_observed

SF = "/root/testdata/sf0.001"


def _final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phase2_reads_the_buckets_of_phase1_without_an_exchange(spark):
    inp = derived_inputs(spark, SF)
    done = run_phases(inp)
    p1 = done["documents"]
    plain = materialize(p1, "plain")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_bucket = phase2(p1, inp.responses, inp.ocr)
        shuffled = phase2(plain, inp.responses, inp.ocr)
        a, b = _final_plan(by_bucket), _final_plan(shuffled)
        assert "Bucketed: true" in a and "Bucketed: true" not in b
        assert a.count("Exchange hashpartitioning") == b.count("Exchange hashpartitioning") - 1
        key = lambda df: sorted(map(repr, df.collect()))
        assert key(by_bucket) == key(shuffled) == key(done["results"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    report = queries()["run_report"](spark, SF).first().asDict()
    rollup = queries()["results_rollup"](spark, SF).first().asDict()
    for want, got in ((report, done["totals"]["documents"]), (rollup, done["totals"]["results"])):
        assert got["seconds"] > 0
        for name, value in want.items():
            assert abs(float(got[name]) - float(value)) < 1e-6, name


def test_buckets_are_written_by_one_task_each(spark):
    """A table that is partitioned by its key already gets one file a bucket at most."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_key = spark.range(5000).groupBy((F.col("id") % 1000).alias("doc_id")).count()
    written = materialize(per_key, "keys", by="doc_id")
    assert written.count() == 1000 and len(written.inputFiles()) <= n


def test_observed_totals_of_an_empty_table(spark):
    written, totals = materialize_observed(spark.range(0), "none", [F.count(F.lit(1)).alias("n"), F.avg("id").alias("a")])
    assert written.count() == 0 and totals["n"] == 0 and totals["a"] is None


def _codes(spark):
    registry = spark.createDataFrame([(c,) for c in ("AB-IO-1", "AB-1O-2", "AB-IO-2", "DE-11-3", "DE-11-3")],
                                     "clientCaseNumber string")
    # One code fills most rows; others repeat, are unknown, blank or null.
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("AB-10-1").alias("raw_code"))
    few = spark.createDataFrame([(1, "AB-I0-2"), (1, "ZZ-9"), (2, "DE-11-3"), (2, " AB-IO-1 "), (3, ""), (3, None), (3, None)],
                                "doc_id long, raw_code string")
    return lookup_tables(ref_codes(registry)), hot.unionByName(few)


def test_codes_matched_once_are_matched_alike(spark):
    lookups, codes = _codes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        once, plain = match_codes_once(codes, "raw_code", lookups), match_codes(codes, "raw_code", lookups)
        assert once.columns == plain.columns
        assert sorted(map(repr, once.collect())) == sorted(map(repr, plain.collect()))
        none = match_codes_once(codes.where("doc_id < 0"), "raw_code", lookups)
        assert none.count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_code_is_spread_and_looked_up_once(spark):
    lookups, codes = _codes(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        once = match_codes_once(codes, "raw_code", lookups)
        plan = _final_plan(once)
        # occurrences are shuffled by code and part only; the lookups see distinct codes
        assert plan.count("_salt#") and HEAVY_CODES == 1000
        sizes = [r["count"] for r in once.where("raw_code = 'AB-10-1'").groupBy(F.spark_partition_id()).count().collect()]
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert len(sizes) >= n // 2 and max(sizes) < 3000 * 0.6
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_first_ocr_tier_fills_only_missing_fields(spark):
    rows = [(("1", None), "KvK", ("9", "NL1")), (("", "NL0"), "KvK", ("9", "NL1")), ((None, None), "", ("9", "NL1")),
            (("1", "NL0"), "KvK", ("9", "NL1")), (None, "KvK", ("9", None))]
    df = spark.createDataFrame([(i, (h,), t, f) for i, (h, t, f) in enumerate(rows)],
                               "i int, r struct<invoiceHeader: struct<kvkNumber: string, vatNumber: string>>, "
                               "t string, f struct<kvkNumber: string, vatNumber: string>")
    ok, kvk, vat = ocr_tier(F.col("r"), F.col("t"), F.col("f"))
    got = [tuple(x) for x in df.orderBy("i").select(ok, kvk, vat).collect()]
    assert got == [(True, "1", "NL1"), (True, "9", "NL0"), (False, None, None), (False, "1", "NL0"), (True, "9", None)]
