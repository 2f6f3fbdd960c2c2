"""Per-document outputs of phase 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.operators.matching import VERDICT_REJECT

# FIXED VALUES: confidence weights (added in this order, capped at 1.0).
CONF_NOT_COACHING_TEXT, CONF_NOT_COACHING_EMPTY = 0.1, 0.0
CONF_BASE, CONF_DATES, CONF_AMOUNTS, CONF_NUMBER = 0.4, 0.2, 0.2, 0.1
CONF_LONG, CONF_MEDIUM = 0.1, 0.05
LONG_TEXT, MEDIUM_TEXT = 500, 100
PREVIEW_CHARS = 500
CASE_PREVIEW = 5
# FIXED VALUES: raw-text envelope lines.
ENVELOPE_TITLE = "=== RAW TEXT EXTRACTION ==="
ENVELOPE_RULE = "=" * 60


def is_coaching(patterns: Column) -> Column:
    return F.size(patterns["client_cases"]) > 0


def confidence(coaching: Column, patterns: Column, text_length: Column) -> Column:
    """Heuristic score; double additions in the same order as the rule."""
    def add(cond: Column, w: float) -> Column:
        return F.when(cond, F.lit(w)).otherwise(F.lit(0.0))

    score = F.lit(CONF_BASE)
    score = score + add(F.size(patterns["dates"]) > 0, CONF_DATES)
    score = score + add(F.size(patterns["amounts"]) > 0, CONF_AMOUNTS)
    score = score + add(F.size(patterns["invoice_numbers"]) > 0, CONF_NUMBER)
    score = score + (F.when(text_length > LONG_TEXT, F.lit(CONF_LONG))
                     .when(text_length > MEDIUM_TEXT, F.lit(CONF_MEDIUM)).otherwise(F.lit(0.0)))
    return (F.when(~coaching, F.when(text_length > 0, F.lit(CONF_NOT_COACHING_TEXT))
                   .otherwise(F.lit(CONF_NOT_COACHING_EMPTY)))
            .otherwise(F.least(score, F.lit(1.0))))


def _gate() -> Column:
    return (F.col("is_coaching_invoice") & (F.col("text_length") > 0)
            & (F.col("client_case_summary.verdict") != VERDICT_REJECT))


def with_doc_features(annotated: DataFrame) -> DataFrame:
    """Add is_coaching_invoice, confidence_score and ready_for_llm. The counted codes tell a
    coaching invoice where a registry was given, so a plan that asks for no pattern does not
    search the texts again on this side of the join."""
    p = F.col("patterns")
    coaching = F.coalesce(F.col("has_codes"), is_coaching(p))
    return (annotated.withColumn("is_coaching_invoice", coaching).drop("has_codes")
            .withColumn("confidence_score", confidence(F.col("is_coaching_invoice"), p, F.col("text_length")))
            .withColumn("ready_for_llm", _gate()))


def with_gate(annotated: DataFrame) -> DataFrame:
    """Add is_coaching_invoice and ready_for_llm by the counted codes alone (needs a registry)."""
    return annotated.withColumn("is_coaching_invoice", F.col("has_codes")).drop("has_codes").withColumn("ready_for_llm", _gate())


def header_hints(patterns: Column) -> Column:
    """First kvk / vat / invoice number / parsed date (NULL when none)."""
    return F.struct(F.get(patterns["kvk_numbers"], 0).alias("kvk"),
                    F.get(patterns["vat_numbers"], 0).alias("vat"),
                    F.get(patterns["invoice_numbers"], 0).alias("invoice_number"),
                    F.get(patterns["dates"], 0).alias("invoice_date"))


def doc_summary(docs: DataFrame) -> DataFrame:
    """Summary table (wall-clock processing time is not a data property and
    is left out)."""
    p = F.col("patterns")
    return docs.select(
        "doc_id", "filename", "text_length", "extraction_method",
        F.size(p["client_cases"]).alias("client_cases_found"),
        F.array_join(p["client_cases"], "|").alias("all_case_numbers"),
        F.array_join(p["invoice_numbers"], "|").alias("invoice_numbers"),
        F.size(p["amounts"]).alias("amounts_found"),
        F.array_max(p["amounts"]).alias("max_amount"),
        "confidence_score",
        F.col("error_message").isNotNull().alias("has_error"))


def verdict_label(verdict: Column) -> Column:
    """Traffic-light label of a verdict."""
    v = F.upper(F.coalesce(verdict, F.lit("N/A")))
    return F.when(v == "ACCEPT", "green").when(v == "NEEDS_REVIEW", "amber").otherwise("red")


def case_preview(codes: Column) -> Column:
    """First five codes joined by ', ' plus '... and n more' when longer."""
    head = F.array_join(F.slice(codes, 1, CASE_PREVIEW), ", ")
    n_more = F.size(codes) - CASE_PREVIEW
    return F.when(F.size(codes) == 0, F.lit(None)).when(
        n_more > 0, F.concat(head, F.lit(" ... and "), n_more.cast("string"), F.lit(" more"))
    ).otherwise(head)


def raw_text_file(filename: Column) -> Column:
    return F.concat(F.lit("raw_texts/"), F.replace(filename, F.lit(".pdf"), F.lit("_raw.txt")))


def raw_text_envelope(filename: Column, text: Column, extracted_at: Column) -> Column:
    """The saved raw text: four header lines, a blank line, then the text."""
    return F.concat(F.lit(ENVELOPE_TITLE + "\n"), F.lit("Source: "), filename, F.lit("\n"),
                    F.lit("Extraction Date: "), extracted_at, F.lit("\n"),
                    F.lit(ENVELOPE_RULE + "\n\n"), F.coalesce(text, F.lit("")))


def text_preview(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.left(text, F.lit(PREVIEW_CHARS)))


def matches_map(matches: Column) -> Column:
    """raw code -> match record (keys are distinct per document)."""
    return F.map_from_entries(F.transform(matches, lambda m: F.struct(m["raw_code"], m["match"])))


def metadata_record(docs: DataFrame) -> DataFrame:
    """Per-document metadata (filename + the eleven metadata fields)."""
    p = F.col("patterns")
    hints = header_hints(p)
    has_text = F.length("text") > 0
    patterns_out = F.when(has_text, F.struct(
        *[p[k].alias(k) for k in ("client_cases", "invoice_numbers", "dates_raw", "dates",
                                  "amounts", "emails", "vat_numbers", "kvk_numbers")],
        F.when(F.size("matches") > 0, matches_map(F.col("matches"))).alias("client_case_matches")))
    return docs.select(
        "doc_id", "filename", "text_length", "extraction_method", "confidence_score",
        hints["kvk"].alias("kvk"), hints["vat"].alias("vat"),
        hints["invoice_number"].alias("invoice_number"),
        hints["invoice_date"].alias("invoice_date"),
        patterns_out.alias("patterns_found"), "client_case_summary",
        raw_text_file(F.col("filename")).alias("raw_text_file"),
        text_preview(F.col("text")).alias("text_preview"))


def manifest_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", "filename", F.col("confidence_score").alias("confidence"),
        "is_coaching_invoice",
        F.col("client_case_summary.verdict").alias("client_case_verdict"),
        F.col("client_case_summary.reason").alias("client_case_reason"), "ready_for_llm")


def manifest_rollup(manifest: DataFrame) -> DataFrame:
    """Manifest header: one row of totals (partial aggregates only).

    The invoice entries stay a table (``manifest_rows``); they are never
    collected into one row, so the manifest scales with the batch.
    """
    return manifest.agg(
        F.count(F.lit(1)).alias("total_invoices"),
        F.count_if(F.col("ready_for_llm")).alias("ready_invoices"),
        F.count_if(F.col("is_coaching_invoice")).alias("coaching_invoices"))


def run_metrics(n_cases: Column, n_amounts: Column) -> list[Column]:
    """Run totals of phase 1, from a document's numbers of codes and amounts."""
    return [F.count(F.lit(1)).alias("total"),
            F.count_if(F.col("text_length") > 0).alias("successful"),
            F.avg("text_length").alias("avg_text_length"),
            F.avg("confidence_score").alias("avg_confidence"),
            F.count_if(n_cases > 0).alias("with_cases"),
            F.count_if(n_amounts > 0).alias("with_amounts")]


def run_report(summary: DataFrame) -> DataFrame:
    """Run totals in one aggregate (map-side partial, one tiny final task)."""
    return summary.agg(*run_metrics(F.col("client_cases_found"), F.col("amounts_found")))
