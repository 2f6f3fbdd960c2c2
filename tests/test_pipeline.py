"""End-to-end pipeline with phase outputs written to the checkpoint folder."""

from invoxa.plans.pipeline import run_all
from invoxa.session import checkpoint_dir


def test_run_all_materializes_phases(spark):
    out = run_all(spark, "/root/testdata/sf0.001")
    assert checkpoint_dir(spark)
    docs, results, scores = out["documents"], out["results"], out["scores"]
    n_ready = docs.where("ready_for_llm AND is_coaching_invoice").count()
    assert results.count() == n_ready > 0
    final = out["final_score"].first()
    assert final.n_evaluated == scores.where("evaluated").count() > 0
    assert 0.0 <= final.final_score <= 100.0
