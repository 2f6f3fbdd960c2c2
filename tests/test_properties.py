
from pyspark.sql import functions as F

from invoxa.operators.responses import allowed_long
from invoxa.plans.pipeline import derived_inputs, phase1, phase2

SF = "/root/testdata/sf0.001"


def test_semi_plus_anti_is_input_and_status_counts_sum(spark):
    inp = derived_inputs(spark, SF)
    p1 = phase1(inp.pages, inp.registry).cache()
    try:
        # status counts add up to the distinct raw codes of each document
        c = F.col("client_case_summary.counts")
        bad = p1.where((c["exact"] + c["fuzzy_io_swap"] + c["unknown"] + c["ambiguous_io_swap"])
                       != F.size(F.array_distinct("patterns.client_cases"))).count()
        assert bad == 0
        final = phase2(p1, inp.responses, inp.ocr, keep_corrected=True)
        kept, dropped = allowed_long(final)
        total = final.select(F.sum(F.size("corrected_cases") + F.size("corrected_no_activity"))).first()[0]
        assert kept.count() + dropped.count() == total
        assert kept.join(dropped, ["doc_id", "kind", "pos"], "inner").count() == 0
    finally:
        p1.unpersist()
