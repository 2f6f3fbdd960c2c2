"""The three phases as composed DataFrame plans.

Phase 1  pages -> text -> patterns -> matches/verdict -> per-document record
Phase 2  work list + model responses + OCR text -> final invoice results
Phase 3  final results vs ground truth -> per-document and overall scores

Each phase is lazy; ``run_all`` writes phase outputs to the shared checkpoint
folder between phases (the hand-off the batch tool does through files),
which also bounds recomputation after a lost executor.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.operators.documents import run_metrics, with_doc_features, with_gate
from invoxa.operators.evaluation import evaluate, final_score
from invoxa.operators.extract import with_patterns
from invoxa.operators.matching import annotate_coded, annotate_documents, lookup_tables, ref_codes
from invoxa.operators.responses import classify_attempts, final_results, resolve_attempts, result_metrics
from invoxa.operators.text import document_text
from invoxa.session import materialize_observed
from invoxa.sources import fixtures


@dataclass
class Inputs:
    pages: DataFrame
    registry: DataFrame | None
    responses: DataFrame
    ocr: DataFrame
    truth: DataFrame


def derived_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    return Inputs(pages=fixtures.invoice_pages(spark, sf_dir),
                  registry=fixtures.registry_codes(spark, sf_dir),
                  responses=fixtures.model_responses(spark, sf_dir),
                  ocr=fixtures.ocr_texts(spark, sf_dir),
                  truth=fixtures.truth(spark, sf_dir))


def phase1(pages: DataFrame, registry: DataFrame | None) -> DataFrame:
    """Per-document record: text, patterns, matches, verdict, confidence,
    gate and LLM context. One shuffle (pages by doc_id)."""
    docs = with_patterns(document_text(pages))
    lookups = lookup_tables(ref_codes(registry)) if registry is not None else None
    return with_doc_features(annotate_documents(docs, lookups))


def phase1_coded(pages: DataFrame, registry: DataFrame | None) -> DataFrame:
    """``phase1`` for phase 2 alone: the documents with codes (the others are on no work list),
    without texts, patterns and confidence, so that pages are put together once and nothing is
    joined back to them."""
    if registry is None:
        return phase1(pages, registry)
    docs = with_patterns(document_text(pages))
    return with_gate(annotate_coded(docs, lookup_tables(ref_codes(registry)), ("filename", "text_length")))


def phase1_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phase1(fixtures.invoice_pages(spark, sf_dir), fixtures.registry_codes(spark, sf_dir))


def work_list(p1: DataFrame) -> DataFrame:
    """Documents handed to the model stage: coaching, ready, named."""
    return p1.where(F.col("is_coaching_invoice") & F.col("ready_for_llm")
                    & F.coalesce(F.length("filename") > 0, F.lit(False)))


def phase2(p1: DataFrame, responses: DataFrame, ocr: DataFrame,
           keep_corrected: bool = False) -> DataFrame:
    """Final results for the work list (see ``operators.responses``)."""
    work = work_list(p1).select("doc_id", "filename", "correction_map", "allowed_valid")
    resolved = resolve_attempts(classify_attempts(responses))
    return final_results(work, resolved, ocr.select("doc_id", "text"), keep_corrected)


def phase3(final: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate(final, truth)


def run_phases(inp: Inputs) -> dict[str, object]:
    """Phases 1 and 2, each written to the shared checkpoint folder, and their ``totals``
    (phase -> metric -> value, with ``seconds``), observed while the tables are written.

    Phase 1 is written in buckets of ``doc_id``: phase 2 joins it to answers and OCR texts
    without shuffling it again. Results are joined by output name later, which is not the key
    that they are partitioned by, so buckets would only move that shuffle.
    """
    p = F.col("patterns")
    p1, of_documents = materialize_observed(phase1(inp.pages, inp.registry), "phase1_documents",
                                            run_metrics(F.size(p["client_cases"]), F.size(p["amounts"])), by="doc_id")
    final, of_results = materialize_observed(phase2(p1, inp.responses, inp.ocr), "phase2_results", result_metrics())
    return {"documents": p1, "results": final, "totals": {"documents": of_documents, "results": of_results}}


def run_all(spark: SparkSession, sf_dir: str) -> dict[str, object]:
    """Whole pipeline with phase outputs written to the shared checkpoint
    folder (lineage cut between phases)."""
    inp = derived_inputs(spark, sf_dir)
    done = run_phases(inp)
    scored, of_scores = materialize_observed(phase3(done["results"], inp.truth), "phase3_scores", [F.count(F.lit(1)).alias("n_truth")])
    done["totals"]["scores"] = of_scores
    return {**done, "scores": scored, "final_score": final_score(scored)}
