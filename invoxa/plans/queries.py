"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each reads the driver's tables (through the derived invoice fixtures) over
the whole data. List-valued results are returned in long form (one row per
element with its 0-based position) or joined with '|', so that the DuckDB
oracle can compare them value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.operators import documents as D
from invoxa.operators import paged
from invoxa.operators.extract import FAMILIES, family_long, with_patterns
from invoxa.operators.matching import (annotate_documents, lookup_tables, match_cases, match_cases_once,
                                       ref_canon, ref_codes)
from invoxa.operators.text import assemble_text, document_text
from invoxa.plans.pipeline import phase1
from invoxa.sources import fixtures
from invoxa.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    name = fn.__name__
    QUERIES[name[:-2] if name.endswith("_q") else name] = fn
    return fn


def _pages(spark, sf):
    return fixtures.invoice_pages(spark, sf)


def _registry(spark, sf):
    return ref_codes(fixtures.registry_codes(spark, sf))


def _docs(spark, sf):
    return with_patterns(document_text(_pages(spark, sf)))


def _p1(spark, sf):
    return phase1(_pages(spark, sf), fixtures.registry_codes(spark, sf))


# ----------------------------------------------------------------- registry
@query
def ref_codes_q(spark, sf):
    return _registry(spark, sf).select("code", "canon")


@query
def ref_canon_q(spark, sf):
    r = ref_canon(_registry(spark, sf))
    return r.select("canon", F.array_join("candidates", "|").alias("candidates"),
                    F.col("n").cast("long").alias("n"))


# --------------------------------------------------------------- text/patterns
@query
def assemble_text_q(spark, sf):
    return assemble_text(_pages(spark, sf))


@query
def text_fallback(spark, sf):
    return document_text(_pages(spark, sf))


def _family(family: str) -> Query:
    def q(spark, sf):
        return family_long(_docs(spark, sf), family)
    q.__name__ = f"extract_{family}"
    return q


for _f in ("client_cases", "invoice_numbers", "dates_raw", "dates", "amounts", "emails",
           "vat_numbers", "kvk_numbers"):
    query(_family(_f))


def _paged_family(family: str) -> Query:
    def q(spark, sf):
        return paged.family_rows(_pages(spark, sf), family)
    q.__name__ = f"paged_{family}"
    return q


for _f in FAMILIES:
    query(_paged_family(_f))


@query
def paged_state(spark, sf):
    """Method, error and text length of every document, without its text in one row."""
    return paged.document_state(_pages(spark, sf))


@query
def extract_emails_documents(spark, sf):
    """E-mail family over the driver's free-text ``documents`` (whole texts)."""
    docs = table(spark, sf, "documents", "doc_id", "text")
    return family_long(with_patterns(docs), "emails")


@query
def header_fields_documents(spark, sf):
    """Header best guess (first kvk / vat / invoice number) over ``documents``."""
    from invoxa.functions.parsers import header_fields
    docs = table(spark, sf, "documents", "doc_id", "text")
    h = header_fields(F.col("text"))
    return docs.select("doc_id", h["kvkNumber"].alias("kvkNumber"),
                       h["vatNumber"].alias("vatNumber"),
                       h["invoiceNumber"].alias("invoiceNumber"))


# ------------------------------------------------------------- matching
@query
def match_cases_q(spark, sf):
    return _match_columns(match_cases(_docs(spark, sf), lookup_tables(_registry(spark, sf))))


@query
def match_cases_once_q(spark, sf):
    """The same rows, each distinct code matched once."""
    return _match_columns(match_cases_once(_docs(spark, sf), lookup_tables(_registry(spark, sf))))


def _match_columns(m):
    return m.select("doc_id", "case_pos", "raw_code",
                    F.col("match.matchedCode").alias("matched_code"),
                    F.col("match.matchStatus").alias("match_status"),
                    F.col("match.matchConfidence").alias("match_confidence"),
                    F.col("match.contamination").alias("contamination"),
                    F.array_join("match.candidates", "|").alias("candidates"),
                    F.col("match.notes").alias("notes"))


@query
def verdict_counts(spark, sf):
    c = F.col("client_case_summary.counts")
    return _p1(spark, sf).select(
        "doc_id", c["exact"].alias("n_exact"), c["fuzzy_io_swap"].alias("n_fuzzy"),
        c["unknown"].alias("n_unknown"), c["ambiguous_io_swap"].alias("n_ambiguous"))


@query
def doc_verdict(spark, sf):
    return _p1(spark, sf).select("doc_id", "filename",
                                 F.col("client_case_summary.verdict").alias("verdict"),
                                 F.col("client_case_summary.reason").alias("reason"))


@query
def verdict_no_registry(spark, sf):
    p = with_patterns(document_text(_pages(spark, sf)))
    a = D.with_doc_features(annotate_documents(p, None))
    return a.select("doc_id", F.col("client_case_summary.verdict").alias("verdict"),
                    F.col("client_case_summary.reason").alias("reason"), "ready_for_llm")


# ------------------------------------------------------------- doc outputs
@query
def doc_confidence(spark, sf):
    return _p1(spark, sf).select("doc_id", "is_coaching_invoice", "confidence_score",
                                 "ready_for_llm")


@query
def doc_summary(spark, sf):
    return D.doc_summary(_p1(spark, sf))


@query
def header_hints(spark, sf):
    h = D.header_hints(F.col("patterns"))
    return _p1(spark, sf).select("doc_id", h["kvk"].alias("kvk"), h["vat"].alias("vat"),
                                 h["invoice_number"].alias("invoice_number"),
                                 h["invoice_date"].alias("invoice_date"))


@query
def metadata_record(spark, sf):
    m = D.metadata_record(_p1(spark, sf))
    return m.select("doc_id", "filename", "text_length", "extraction_method",
                    "confidence_score", "kvk", "vat", "invoice_number", "invoice_date",
                    F.col("client_case_summary.verdict").alias("verdict"),
                    F.size(F.map_keys("patterns_found.client_case_matches")).alias("n_matches"),
                    "raw_text_file", "text_preview")


@query
def metadata_matches(spark, sf):
    """The match records inside the metadata, one row per document and raw code."""
    m = D.metadata_record(_p1(spark, sf))
    rows = m.select("doc_id", F.explode_outer("patterns_found.client_case_matches").alias("raw_code", "m"))
    return rows.where(F.col("raw_code").isNotNull()).select(
        "doc_id", "raw_code", F.col("m.matchedCode").alias("matched_code"),
        F.col("m.matchStatus").alias("match_status"), F.col("m.matchConfidence").alias("match_confidence"),
        F.col("m.contamination").alias("contamination"),
        F.array_join("m.candidates", "|").alias("candidates"), F.col("m.notes").alias("notes"))


@query
def work_list_q(spark, sf):
    """The work list from the three written outputs of phase 1 (manifest, metadata, raw
    texts), read back and joined on the file name, with hints and context."""
    from invoxa.session import handed_over, run_path
    from invoxa.sources import files
    out = run_path(spark, "work_list_files")
    # The context is worked out again from the saved matches, as the hand-off by files has it.
    with handed_over(_p1(spark, sf).drop("allowed_prompt", "allowed_valid", "correction_map"), "work_list_documents") as p1:
        files.write_manifest(D.manifest_rows(p1), f"{out}/manifest")
        files.write_metadata(D.metadata_record(p1), f"{out}/metadata")
        files.write_raw_texts(p1, f"{out}/raw_texts", "1970-01-01T00:00:00")
    w = files.work_list_from_files(files.read_manifest_lines(spark, f"{out}/manifest"),
                                   files.read_metadata_lines(spark, f"{out}/metadata"),
                                   files.read_raw_text_table(spark, f"{out}/raw_texts"))
    pairs = F.transform(F.map_entries("correction_map"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return w.select("filename", "raw_text", "kvk", "vat", "invoice_date", "invoice_number",
                    F.array_join("allowed_prompt", "|").alias("allowed_prompt"),
                    F.array_join("allowed_valid", "|").alias("allowed_valid"),
                    F.array_join(pairs, "|").alias("correction_pairs"))


@query
def manifest_rows(spark, sf):
    return D.manifest_rows(_p1(spark, sf)).drop("doc_id")


@query
def manifest_rollup(spark, sf):
    return D.manifest_rollup(D.manifest_rows(_p1(spark, sf)))


@query
def run_report(spark, sf):
    return D.run_report(D.doc_summary(_p1(spark, sf)))


@query
def case_preview(spark, sf):
    return _p1(spark, sf).select("doc_id", D.case_preview(F.col("patterns.client_cases"))
                                 .alias("preview"))


@query
def verdict_label(spark, sf):
    return _p1(spark, sf).select("doc_id",
                                 D.verdict_label(F.col("client_case_summary.verdict"))
                                 .alias("label"))


@query
def raw_text_envelope(spark, sf):
    p = document_text(_pages(spark, sf))
    stamp = F.lit("1970-01-01T00:00:00")
    return p.select("doc_id", D.raw_text_file(F.col("filename")).alias("raw_text_file"),
                    D.raw_text_envelope(F.col("filename"), F.col("text"), stamp).alias("content"))


@query
def doc_context(spark, sf):
    return _p1(spark, sf).select(
        "doc_id", "filename", F.array_join("allowed_prompt", "|").alias("allowed_prompt"),
        F.array_join("allowed_valid", "|").alias("allowed_valid"),
        F.array_join(F.transform(F.map_entries("correction_map"),
                                 lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
        .alias("correction_pairs"))


# ------------------------------------------------------------- phase 2
def _inputs(spark, sf):
    from invoxa.plans.pipeline import derived_inputs
    return derived_inputs(spark, sf)


def _final(spark, sf, keep_corrected=False):
    from invoxa.plans.pipeline import phase1_coded, phase2
    inp = _inputs(spark, sf)
    return phase2(phase1_coded(inp.pages, inp.registry), inp.responses, inp.ocr, keep_corrected)


@query
def carve_json_q(spark, sf):
    from invoxa.functions.jsonish import carve_json
    r = fixtures.model_responses(spark, sf)
    return r.select("doc_id", "agent", "attempt", carve_json(F.col("response_text")).alias("carved"))


@query
def classify_attempts_q(spark, sf):
    from invoxa.operators.responses import classify_attempts
    return classify_attempts(fixtures.model_responses(spark, sf)).select(
        "doc_id", "agent", "attempt", "cls")


@query
def resolve_attempts_q(spark, sf):
    from invoxa.operators.responses import classify_attempts, resolve_attempts
    r = resolve_attempts(classify_attempts(fixtures.model_responses(spark, sf)))
    return r.select("doc_id", F.col("header_res").isNotNull().alias("header_resolved"),
                    F.col("lines_res").isNotNull().alias("lines_resolved"),
                    F.col("recovery_res").isNotNull().alias("recovery_resolved"))


@query
def resolved_header(spark, sf):
    """The header values that the attempts of a document end with."""
    from invoxa.operators.responses import classify_attempts, resolve_attempts
    r = resolve_attempts(classify_attempts(fixtures.model_responses(spark, sf)))
    h = F.col("header_res")
    return r.where(h.isNotNull()).select(
        "doc_id", *[h["invoiceHeader"][f].alias(f) for f in
                    ("supplierName", "invoiceNumber", "invoiceDate", "kvkNumber", "vatNumber")],
        h["isCoachingInvoice"].alias("isCoachingInvoice"))


@query
def validate_header(spark, sf):
    from invoxa.functions.jsonish import header_from_variant, parse_response
    r = fixtures.model_responses(spark, sf).where(
        (F.col("agent") == "header") & F.col("response_text").isNotNull())
    r = r.withColumn("_json", parse_response(F.col("response_text")))
    r = r.withColumn("_h", header_from_variant(F.col("_json")))
    h = F.col("_h")
    ih = h["invoiceHeader"]
    return r.select("doc_id", "attempt", h.isNotNull().alias("valid"),
                    *[ih[f].alias(f) for f in ("supplierName", "invoiceNumber", "invoiceDate",
                                               "kvkNumber", "vatNumber")],
                    h["isCoachingInvoice"].alias("isCoachingInvoice"))


@query
def validate_lines(spark, sf):
    from invoxa.functions.jsonish import item_facts, lines_from_variant, parse_response
    r = fixtures.model_responses(spark, sf).where(
        (F.col("agent") == "lines") & F.col("response_text").isNotNull())
    r = r.withColumn("_json", parse_response(F.col("response_text"), lines=True))
    r = r.withColumn("_facts", item_facts(F.col("_json")))
    r = r.withColumn("_l", lines_from_variant(F.col("_json"), F.col("_facts")))
    x = F.col("_l")
    return r.select("doc_id", "attempt", x.isNotNull().alias("valid"),
                    F.size(x["clientCases"]).alias("n_cases"),
                    F.array_join(x["clientCasesNoActivity"], "|").alias("no_activity"))


@query
def validate_line_items(spark, sf):
    """The line items of every valid answer, in order."""
    from invoxa.functions.jsonish import item_facts, lines_from_variant, parse_response
    r = fixtures.model_responses(spark, sf).where(
        (F.col("agent") == "lines") & F.col("response_text").isNotNull())
    r = r.withColumn("_json", parse_response(F.col("response_text"), lines=True))
    r = r.withColumn("_facts", item_facts(F.col("_json")))
    x = lines_from_variant(F.col("_json"), F.col("_facts"))
    items = r.select("doc_id", "attempt", F.posexplode_outer(x["clientCases"]).alias("pos", "c"))
    return items.where(F.col("c").isNotNull()).select(
        "doc_id", "attempt", "pos", F.col("c.validatedClientCaseNumber").alias("validated"),
        F.col("c.rawClientCaseNumber").alias("raw"), F.col("c.date").alias("date"),
        F.col("c.durationHours").alias("hours"))


@query
def needs_ocr(spark, sf):
    return _final(spark, sf).select("doc_id", "needs_ocr")


@query
def recover_header(spark, sf):
    f = _final(spark, sf)
    return f.select("doc_id", F.col("invoiceHeader.kvkNumber").alias("kvkNumber"),
                    F.col("invoiceHeader.vatNumber").alias("vatNumber"))


@query
def recovery_source(spark, sf):
    """Where a document's kvk and vat come from: model, OCR text or recovery answer."""
    return _final(spark, sf).select("doc_id", "kvk_source", "vat_source")


@query
def final_results_q(spark, sf):
    f = _final(spark, sf)
    h = F.col("invoiceHeader")
    return f.select("doc_id", "filename",
                    *[h[c].alias(c) for c in ("supplierName", "invoiceNumber", "invoiceDate",
                                              "kvkNumber", "vatNumber")],
                    "isCoachingInvoice", F.size("clientCases").alias("n_cases"),
                    F.array_join("clientCasesNoActivity", "|").alias("no_activity"))


@query
def final_cases(spark, sf):
    f = _final(spark, sf)
    return f.select("doc_id", F.posexplode("clientCases").alias("pos", "c")).select(
        "doc_id", "pos", F.col("c.validatedClientCaseNumber").alias("validated"),
        F.col("c.rawClientCaseNumber").alias("raw"), F.col("c.date").alias("date"),
        F.col("c.durationHours").alias("hours"))


@query
def enforce_allowed_q(spark, sf):
    from invoxa.operators.responses import allowed_long
    kept, _ = allowed_long(_final(spark, sf, keep_corrected=True))
    return kept


@query
def dropped_codes(spark, sf):
    from invoxa.operators.responses import allowed_long
    _, dropped = allowed_long(_final(spark, sf, keep_corrected=True))
    return dropped


@query
def result_json_q(spark, sf):
    from invoxa.operators.responses import result_json
    return result_json(_final(spark, sf))


# ------------------------------------------------------------- phase 3
def _scored(spark, sf):
    from invoxa.operators.evaluation import evaluate
    return evaluate(_final(spark, sf), fixtures.truth(spark, sf))


@query
def eval_docs(spark, sf):
    return _scored(spark, sf).select("truth_file", "output_file", "evaluated", "points", "accuracy")


@query
def eval_fields(spark, sf):
    return _scored(spark, sf).where("evaluated").select(
        "truth_file", "f_supplierName", "f_invoiceNumber", "f_invoiceDate", "f_kvkNumber",
        "f_vatNumber", "line_items_ok", "no_activity_ok")


@query
def eval_missing(spark, sf):
    from invoxa.operators.evaluation import missing_outputs
    return missing_outputs(_scored(spark, sf))


@query
def eval_final(spark, sf):
    from invoxa.operators.evaluation import final_score
    return final_score(_scored(spark, sf))


@query
def eval_by_field(spark, sf):
    from invoxa.operators.evaluation import accuracy_by_field
    return accuracy_by_field(_scored(spark, sf))


@query
def eval_case_diff(spark, sf):
    return _scored(spark, sf).where("evaluated").select(
        "truth_file", F.array_join("missing_codes", "|").alias("missing_codes"),
        F.array_join("unexpected_codes", "|").alias("unexpected_codes"))


@query
def eval_report(spark, sf):
    return _scored(spark, sf).where("evaluated").select(
        "truth_file", F.array_join("report", "\n").alias("report"))


# ------------------------------------------------------------- line rules
@query
def line_items_regex(spark, sf):
    from invoxa.operators.lines import line_items
    return line_items(document_text(_pages(spark, sf)))


@query
def hours_by_case_date(spark, sf):
    from invoxa.operators.lines import hours_by_case_date as agg, line_items
    return agg(line_items(document_text(_pages(spark, sf))))


# ------------------------------------------------------------- prompts, rollup
@query
def prompts(spark, sf):
    """Header and line-item prompt per work-list document: hints from phase 1, and the
    raw text as it is saved, envelope included."""
    from invoxa.operators.prompts import header_prompt, line_prompt
    from invoxa.plans.pipeline import work_list
    w = work_list(_p1(spark, sf))
    h = D.header_hints(F.col("patterns"))
    saved = D.raw_text_envelope(F.col("filename"), F.col("text"), F.lit("1970-01-01T00:00:00"))
    return w.select("doc_id",
                    header_prompt(saved, h["kvk"], h["vat"], h["invoice_date"],
                                  h["invoice_number"]).alias("header_prompt"),
                    line_prompt(saved, F.col("allowed_prompt")).alias("line_prompt"))


@query
def recovery_prompts(spark, sf):
    """Recovery prompt for documents that reach tier 2 of the OCR recovery."""
    from invoxa.functions.parsers import header_fields
    from invoxa.operators.prompts import recovery_prompt
    from invoxa.operators.responses import (classify_attempts, needs_second_tier, ocr_tier, resolve_attempts,
                                            wants_ocr)
    from invoxa.plans.pipeline import work_list
    inp = _inputs(spark, sf)
    w = work_list(phase1(inp.pages, inp.registry)).select("doc_id")
    r = resolve_attempts(classify_attempts(inp.responses)).select("doc_id", "header_res")
    x = w.join(r, "doc_id", "left").join(inp.ocr.select("doc_id", "text"), "doc_id", "inner")
    res, text, fields = F.col("header_res"), F.col("text"), F.col("_ocr")
    x = x.withColumn("_ocr", F.when(wants_ocr(res, text), header_fields(text)))
    _, kvk, vat = ocr_tier(res, text, fields)
    h = res["invoiceHeader"]
    prompt = recovery_prompt(
        text, h["supplierName"], h["invoiceNumber"], h["invoiceDate"], F.coalesce(kvk, F.lit("")) == "",
        F.coalesce(vat, F.lit("")) == "", F.coalesce(res["isCoachingInvoice"], F.lit(False)))
    # A filter on the tier's outcome would be pushed below and copy its regexes; one on an
    # outer generator's rows stays above.
    asked = F.when(needs_second_tier(res, text, fields), F.array(prompt))
    rows = x.select("doc_id", F.explode_outer(asked).alias("recovery_prompt"))
    return rows.where(F.col("recovery_prompt").isNotNull())


@query
def results_rollup(spark, sf):
    """Run totals of phase 2: results written, line items, mean per result."""
    from invoxa.operators.responses import result_metrics
    f = _final(spark, sf)
    return f.agg(*result_metrics())


@query
def run_totals(spark, sf):
    """Totals of phases 1 and 2 as observed while their tables are written, one row a metric."""
    from invoxa.plans.pipeline import derived_inputs, run_phases
    totals = run_phases(derived_inputs(spark, sf))["totals"]
    rows = [(phase, name, float(v)) for phase in ("documents", "results") for name, v in totals[phase].items()
            if name != "seconds" and v is not None]
    return spark.createDataFrame(rows, "phase string, metric string, value double")
