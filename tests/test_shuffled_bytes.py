"""What the shuffles carry: plan guards against rows that are wider, or shuffled more often, than needed."""

import os
import re
import time

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from invoxa.operators.evaluation import evaluate
from invoxa.operators.matching import lookup_tables, match_codes, ref_codes
from invoxa.operators.text import document_text
from invoxa.session import checkpoint_dir, handed_over
from invoxa.sources import fixtures

SF = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _plan(df) -> str:
    """Physical plan before it runs, without the numbers of columns."""
    return re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())


def _below(plan: str, exchange: str) -> list[str]:
    """The operators below each exchange of that key, down to the scan, one text each."""
    lines, found = plan.splitlines(), []
    for i, line in enumerate(lines):
        if f"Exchange hashpartitioning({exchange}," in line:
            end = next(k for k in range(i, len(lines)) if "Scan" in lines[k])
            found.append("\n".join(re.sub(r"^[ :+*()\d-]*", "", x) for x in lines[i + 1:end + 1]))
    return found


def test_all_inputs_share_the_shuffle_of_the_lines(no_broadcast):
    lines = [x for x in _below(_plan(queries()["eval_fields"](no_broadcast, SF)), "l_orderkey") if "l_linenumber" in x]
    assert len(lines) == 3 and len(set(lines)) == 1, lines
    # numbers are shuffled as they are read, no texts or lists made of them
    assert "DEMO" not in lines[0] and "Aggregate" not in lines[0]


def test_lines_are_put_together_once(no_broadcast):
    plan = _plan(fixtures.model_responses(no_broadcast, SF))
    assert plan.count("collect_list(") == 1 and "ObjectHashAggregate" not in plan


def test_scoring_shuffles_sets_of_codes_only(no_broadcast):
    truth = fixtures.truth(no_broadcast, SF)
    made = truth.withColumn("filename", F.replace("filename", F.lit(".json"), F.lit(".pdf")))
    sides = [x.split("\n")[0] for x in _below(_plan(evaluate(made, truth)), "_key")]
    assert len(sides) == 2
    for side in sides:
        columns = re.search(r"Project \[(.*)\]", side).group(1)
        names = re.findall(r" AS (\w+)(?=,|$)", columns)
        assert "clientCases" not in names and not any(n.endswith("_cases") for n in names), columns


def test_scores_of_repeated_codes_and_missing_lists(spark):
    def rows(ext, cases, na):
        header = "named_struct('supplierName', 'S', 'invoiceNumber', '1', 'invoiceDate', 'd', 'kvkNumber', 'k', 'vatNumber', cast(null as string))"
        return spark.range(1).selectExpr(f"'a.{ext}' AS filename", f"{header} AS invoiceHeader", f"{cases} AS clientCases",
                                         f"{na} AS clientCasesNoActivity")

    def cases(*codes):
        return "array(" + ", ".join(f"named_struct('validatedClientCaseNumber', '{c}', 'date', '{i}')" for i, c in enumerate(codes)) + ")"

    none = "cast(null as array<struct<validatedClientCaseNumber: string, date: string>>)"
    score = lambda g, t: evaluate(rows("pdf", *g), rows("json", *t)).first()
    x = score((cases("B", "A", "B"), "array('y', 'x', 'y')"), (cases("A", "B"), "array('x', 'y')"))
    assert (x.points, x.line_items_ok, x.no_activity_ok, x.missing_codes, x.report) == (7, True, True, [], [])
    x = score((cases("B", "C"), "array('x')"), (cases("A", "B"), "array('x', 'y')"))
    assert (x.points, x.missing_codes, x.unexpected_codes) == (5, ["A"], ["C"])
    x = score((none, "array('x')"), (cases("A"), "array('x')"))
    assert x.evaluated and x.no_activity_ok and x.line_items_ok is None


def test_codes_are_looked_up_by_one_join(no_broadcast):
    reg = no_broadcast.createDataFrame([(c,) for c in ("DEMO-CASE-110", "DEMO-CASE-I10", "DEMO-CASE-300", "DEMO-CASE-300", " short ")],
                                       "clientCaseNumber string")
    codes = no_broadcast.createDataFrame([(c,) for c in ("DEMO-CASE-110", " DEMO-CASE-I10 ", "DEM0-CASE-110", "DEMO-CASE-300", "short",
                                                         "SHORT", "ZZ", "", None)], "code string")
    df = match_codes(codes, "code", lookup_tables(ref_codes(reg)))
    assert _plan(df).count("SortMergeJoin") == 1
    got = {r.code: r.match and (r.match.matchStatus, r.match.matchedCode) for r in df.collect()}
    assert got == {"DEMO-CASE-110": ("exact", "DEMO-CASE-110"), " DEMO-CASE-I10 ": ("exact", "DEMO-CASE-I10"),
                   "DEM0-CASE-110": ("ambiguous_io_swap", None), "DEMO-CASE-300": ("exact", "DEMO-CASE-300"),
                   "short": ("exact", "short"), "SHORT": ("fuzzy_io_swap", "short"), "ZZ": ("unknown", None), "": ("unknown", None), None: None}


def test_codes_come_back_to_their_document_by_one_shuffle(no_broadcast):
    plan = _plan(queries()["final_results"](no_broadcast, SF))
    assert re.findall(r"Exchange hashpartitioning\((doc_id[^)]*), \d+\)", plan) == ["doc_id"]


def _shuffle_files(spark) -> int:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def test_a_handed_over_table_goes_with_its_block(spark):
    before = _shuffle_files(spark)
    with handed_over(spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count(), "counts") as counts:
        until = time.monotonic() + 20
        while _shuffle_files(spark) > before and time.monotonic() < until:
            time.sleep(0.2)
        assert _shuffle_files(spark) <= before  # the shuffle went as soon as the table stood
        assert counts.count() == 1000
        folder = os.path.dirname(counts.inputFiles()[0].removeprefix("file://"))
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_work_list_keeps_its_three_outputs_only(spark):
    work = queries()["work_list"](spark, SF)
    tables = f"{checkpoint_dir(spark).removeprefix('file://')}/tables"
    kept = os.listdir(tables)
    assert any(x.startswith("work_list_files") for x in kept) and not any(x.startswith("work_list_documents") for x in kept)
    assert work.count() > 0


def test_pages_are_marked_before_they_are_gathered(spark):
    rows = [(1, "primary", 2, "b" * 40), (1, "primary", 1, "a" * 40), (1, "primary", 3, ""), (1, "primary", 4, None), (1, "secondary", 1, "no"),
            (2, "primary", 1, "short"), (2, "secondary", 10, "z" * 30), (2, "secondary", 9, "y" * 30), (3, "primary", 1, None),
            (4, "primary", 7, "same" * 20), (4, "primary", 7, "same" * 20 + "\t"), (5, "other", 1, "x" * 80)]
    pages = spark.createDataFrame([(d, f"{d}.pdf", e, n, t) for d, e, n, t in rows],
                                  "doc_id long, filename string, extractor string, page_no int, page_text string")
    mark = lambda n, t: f"\n--- Page {n} ---\n{t}\n"
    got = document_text(pages)
    assert {r.doc_id: r.text for r in got.collect()} == {
        1: mark(1, "a" * 40) + mark(2, "b" * 40), 2: mark(9, "y" * 30) + mark(10, "z" * 30), 3: "",
        4: mark(7, "same" * 20) + mark(7, "same" * 20 + "\t"), 5: ""}
    assert not any("--- Page" in x for x in re.findall(r"lambdafunction\(.*", _plan(got)))
