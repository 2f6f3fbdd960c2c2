"""Phase 2: from recorded model responses to final invoice results.

Input tables
  work list     one row per ready document (phase 1 output, filtered)
  responses     (doc_id, agent, attempt, response_text, error); agents
                'header', 'lines', 'header_recovery'
  ocr_texts     (doc_id, text)

Plan: the responses are validated row by row, then resolved with ONE
partially-aggregated group-by on doc_id that handles all three agents; the
work list, the resolved responses and the OCR text are joined on doc_id
(hash-partitioned once each). Everything after the joins -- OCR tiers,
no-activity split, corrections, allow-list -- is row-local array work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.functions.jsonish import (CASE_TYPE, carve_json, header_from_variant, item_facts, lines_from_variant,
                                     list_of_answer, parse_response, plain_header, plain_lines, plain_lines_result)
from invoxa.functions.parsers import header_fields
from invoxa.functions.validation import header_faults, lines_faults, may_quote, message_words

# FIXED VALUES: error fragments (lower-case) that mark an overloaded or
# rate-limited call, which is retried; and the retry budget.
OVERLOAD_MARKERS = ("503", "overloaded", "429", "unavailable")
MAX_RETRIES = 3
AGENTS = ("header", "lines", "header_recovery")

CLS_OK, CLS_STOP, CLS_RETRY = "ok", "stop", "retry"


def is_overload(error: Column) -> Column:
    e = F.lower(error)
    cond = F.lit(False)
    for m in OVERLOAD_MARKERS:
        cond = cond | e.contains(m)
    return F.coalesce(cond, F.lit(False))


def classify_attempts(responses: DataFrame) -> DataFrame:
    """Per attempt: parsed payload and class ok / stop / retry.

    An error counts as 'retry' when it looks like an overload; any other
    error, an empty answer or a response that fails its schema is 'stop'. The
    message of a failed validation quotes the values at fault, so one that holds an
    overload mark makes it a 'retry' as well. Answers of the plain form are read at once, in
    generated code; only the others go through the checks field by field, whose lambdas are
    interpreted.
    """
    text, carved, root, facts = F.col("response_text"), F.col("_carved"), F.col("_json"), F.col("_facts")
    is_lines = F.col("agent") == "lines"
    is_header = F.col("agent").isin("header", "header_recovery")
    checked = F.col("_checked")
    hdr = F.when(~checked, F.col("_header")).when(is_header, header_from_variant(root))
    lns = F.when(~checked, F.col("_lines")).when(is_lines, lines_from_variant(root, facts))
    answered = F.col("error").isNull() & text.isNotNull() & (text != "")
    faults = F.when(is_lines, lines_faults(root, carved, facts)).otherwise(header_faults(root, carved))
    failed = answered & F.col("hdr").isNull() & F.col("lns").isNull()
    quoted = F.when(failed & may_quote(carved, OVERLOAD_MARKERS),
                    F.exists(message_words(F.col("_faults")), is_overload))
    cls = (F.when(F.col("error").isNotNull(),
                  F.when(is_overload(F.col("error")), CLS_RETRY).otherwise(CLS_STOP))
           .when(~answered, CLS_STOP)
           .when(F.col("hdr").isNotNull() | F.col("lns").isNotNull(), CLS_OK)
           .when(F.coalesce(quoted, F.lit(False)), CLS_RETRY).otherwise(CLS_STOP))
    return (responses.where(F.col("attempt").between(0, MAX_RETRIES))
            .withColumn("_carved", F.when(answered, carve_json(text)))
            .withColumn("_listed", F.when(answered, list_of_answer(carved)))
            .withColumn("_header", F.when(is_header, plain_header(F.col("_listed"))))
            .withColumn("_read", F.when(is_lines, plain_lines(F.col("_listed"))))
            .withColumn("_lines", plain_lines_result(F.col("_read")))
            .withColumn("_checked", answered & F.col("_header").isNull() & F.col("_lines").isNull())
            .withColumn("_json", F.when(checked, parse_response(text, is_lines, carved)))
            .withColumn("_facts", F.when(checked & is_lines, item_facts(root)))
            .select("*", hdr.alias("hdr"), lns.alias("lns"))
            .withColumn("_faults", F.when(failed & may_quote(carved, OVERLOAD_MARKERS), faults))
            .select("doc_id", "agent", "attempt", cls.alias("cls"), "hdr", "lns"))


def _bit(n: Column) -> Column:
    """2^n as a long (n in 0..3)."""
    return F.pow(F.lit(2), n).cast("long")


def resolve_attempts(classified: DataFrame) -> DataFrame:
    """One row per doc: resolved header / lines / recovery (NULL = no result).

    Walking attempts 0..3 in order, retries move on and the first other
    outcome decides; a gap in the attempt sequence ends the walk. Expressed
    as one aggregate (min of (attempt, payload) over non-retries + a bitmask
    of retried attempts), so it combines map-side.
    """
    aggs = []
    for a in AGENTS:
        mine = F.col("agent") == a
        decisive = mine & (F.col("cls") != CLS_RETRY)
        aggs.append(F.min(F.when(decisive, F.struct("attempt", "cls", "hdr", "lns")))
                    .alias(f"_w_{a}"))
        aggs.append(F.bit_or(F.when(mine & (F.col("cls") == CLS_RETRY),
                                    _bit(F.col("attempt"))))
                    .alias(f"_m_{a}"))
    g = classified.groupBy("doc_id").agg(*aggs)

    def resolved(a: str, field: str) -> Column:
        w, m = F.col(f"_w_{a}"), F.coalesce(F.col(f"_m_{a}"), F.lit(0))
        need = _bit(w["attempt"]) - 1
        ok = w.isNotNull() & ((m.bitwiseAND(need)) == need) & (w["cls"] == CLS_OK)
        return F.when(ok, w[field])

    return g.select("doc_id", resolved("header", "hdr").alias("header_res"),
                    resolved("lines", "lns").alias("lines_res"),
                    resolved("header_recovery", "hdr").alias("recovery_res"),
                    F.col("_w_header.attempt").alias("header_attempt"),
                    F.col("_w_lines.attempt").alias("lines_attempt"))


def _missing(c: Column) -> Column:
    return c.isNull() | (c == "")


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def needs_recovery(header_res: Column) -> Column:
    """Whether kvk or vat is missing ('' counts as missing)."""
    h = header_res["invoiceHeader"]
    return _missing(h["kvkNumber"]) | _missing(h["vatNumber"])


def wants_ocr(header_res: Column, ocr_text: Column) -> Column:
    """Whether the OCR tiers apply: a field is missing and there is OCR text."""
    return needs_recovery(header_res) & _present(ocr_text)


def ocr_tier(header_res: Column, ocr_text: Column, ocr_fields: Column) -> tuple[Column, Column, Column]:
    """Tier 1: whether it applies, and kvk and vat after it. ``ocr_fields``: the first
    regex hits in the OCR text, which fill missing fields only."""
    h, ok = header_res["invoiceHeader"], wants_ocr(header_res, ocr_text)

    def filled(name: str) -> Column:
        hit, old = ocr_fields[name], h[name]
        return F.when(ok & _present(hit) & _missing(old), hit).otherwise(old)

    return ok, filled("kvkNumber"), filled("vatNumber")


def needs_second_tier(header_res: Column, ocr_text: Column, ocr_fields: Column) -> Column:
    """Whether a field is still missing after tier 1, so that the recovery agent is asked."""
    ok, kvk, vat = ocr_tier(header_res, ocr_text, ocr_fields)
    return ok & (_missing(kvk) | _missing(vat))


def recover_header(header_res: Column, ocr_text: Column, recovery_res: Column,
                   ocr_fields: Column | None = None) -> Column:
    """Header after the OCR tiers; struct(header, kvk_source, vat_source).

    A failed header agent gives an all-null header that is not a coaching
    invoice. If kvk or vat is missing ('' counts as missing) and OCR text
    is non-empty: tier 1 fills missing fields from the first regex hits in
    the OCR text (never overwriting); if one is still missing, tier 2 takes
    the recovery answer's non-empty kvk/vat and overwrites BOTH fields.
    ``ocr_fields``: ``header_fields(ocr_text)``, ideally precomputed into a
    column, since its regexes would be copied into each use.
    """
    h = header_res["invoiceHeader"]
    kvk0, vat0 = h["kvkNumber"], h["vatNumber"]
    t1 = header_fields(ocr_text) if ocr_fields is None else ocr_fields
    ocr_ok, kvk1, vat1 = ocr_tier(header_res, ocr_text, t1)
    tier2 = ocr_ok & (_missing(kvk1) | _missing(vat1)) & recovery_res.isNotNull()
    rh = recovery_res["invoiceHeader"]
    kvk2 = F.when(tier2 & _present(rh["kvkNumber"]), rh["kvkNumber"]).otherwise(kvk1)
    vat2 = F.when(tier2 & _present(rh["vatNumber"]), rh["vatNumber"]).otherwise(vat1)

    def source(v0, v1, answer):
        return (F.when(tier2 & _present(answer), F.lit("recovery"))
                .when(_present(v1) & ~v1.eqNullSafe(v0), F.lit("ocr_regex"))
                .when(_present(v1), F.lit("model")))

    header = F.struct(h["supplierName"].alias("supplierName"),
                      h["invoiceNumber"].alias("invoiceNumber"),
                      h["invoiceDate"].alias("invoiceDate"),
                      kvk2.alias("kvkNumber"), vat2.alias("vatNumber"))
    return F.struct(header.alias("invoiceHeader"),
                    needs_recovery(header_res).alias("needs_ocr"),
                    source(kvk0, kvk1, rh["kvkNumber"]).alias("kvk_source"),
                    source(vat0, vat1, rh["vatNumber"]).alias("vat_source"))


def split_no_activity(lines_res: Column) -> Column:
    """Cases with NULL or zero hours move to the no-activity list (if the
    code is non-empty); the list becomes distinct and sorted. A failed lines
    agent gives two empty lists without this step."""
    cases = lines_res["clientCases"]
    hours = lambda c: c["durationHours"]
    active = F.filter(cases, lambda c: hours(c).isNotNull() & (hours(c) != 0))
    idle = F.transform(F.filter(cases, lambda c: (hours(c).isNull() | (hours(c) == 0))
                                & _present(c["validatedClientCaseNumber"])),
                       lambda c: c["validatedClientCaseNumber"])
    no_act = F.sort_array(F.array_distinct(F.concat(lines_res["clientCasesNoActivity"], idle)))
    empty = F.struct(F.array().cast(f"array<{CASE_TYPE}>").alias("clientCases"),
                     F.array().cast("array<string>").alias("clientCasesNoActivity"))
    return F.when(lines_res.isNull(), empty).otherwise(
        F.struct(active.alias("clientCases"), no_act.alias("clientCasesNoActivity")))


def apply_corrections(cases: Column, no_act: Column, correction_map: Column) -> tuple[Column, Column]:
    """Map model codes through the document's raw->valid map. When the mapped
    code differs, the case keeps the old code as its raw code."""
    def fix(c: Column) -> Column:
        v = c["validatedClientCaseNumber"]
        m = F.try_element_at(correction_map, v)
        changed = m.isNotNull() & (m != v)
        return F.struct(F.when(changed, m).otherwise(v).alias("validatedClientCaseNumber"),
                        F.when(changed, v).otherwise(c["rawClientCaseNumber"]).alias("rawClientCaseNumber"),
                        c["date"].alias("date"), c["durationHours"].alias("durationHours"))

    fixed_na = F.transform(no_act, lambda c: F.coalesce(F.try_element_at(correction_map, c), c))
    return F.transform(cases, fix), F.sort_array(F.array_distinct(fixed_na))


def enforce_allowed(cases: Column, no_act: Column, allowed: Column) -> tuple[Column, Column]:
    """Keep only codes in the document's allow-list (valid registry codes)."""
    kept = F.filter(cases, lambda c: F.array_contains(allowed, c["validatedClientCaseNumber"]))
    kept_na = F.sort_array(F.array_distinct(F.filter(no_act, lambda c: F.array_contains(allowed, c))))
    return kept, kept_na


def final_results(work: DataFrame, resolved: DataFrame, ocr: DataFrame,
                  keep_corrected: bool = False) -> DataFrame:
    """Final invoice result per work-list document.

    ``work``: doc_id, filename, correction_map, allowed_valid.
    Output: doc_id, filename, invoiceHeader, isCoachingInvoice, clientCases,
    clientCasesNoActivity, needs_ocr, kvk_source, vat_source.
    """
    x = (work.join(resolved, "doc_id", "left")
         .join(ocr.select("doc_id", F.col("text").alias("ocr_text")), "doc_id", "left"))
    hdr_in = F.coalesce(F.col("header_res"), F.struct(
        F.struct(*[F.lit(None).cast("string").alias(f) for f in
                   ("supplierName", "invoiceNumber", "invoiceDate", "kvkNumber", "vatNumber")])
        .alias("invoiceHeader"), F.lit(False).alias("isCoachingInvoice")))
    # The regexes run once, and only on texts of documents that need them.
    wanted = wants_ocr(F.col("_hdr"), F.col("ocr_text"))
    x = (x.withColumn("_hdr", hdr_in)
         .withColumn("_ocr", F.when(wanted, header_fields(F.col("ocr_text")))))
    rec = recover_header(F.col("_hdr"), F.col("ocr_text"), F.col("recovery_res"), F.col("_ocr"))
    lines = split_no_activity(F.col("lines_res"))
    cases, no_act = apply_corrections(lines["clientCases"], lines["clientCasesNoActivity"],
                                      F.col("correction_map"))
    staged = x.select("doc_id", "filename", "allowed_valid", rec.alias("rec"),
                      F.col("_hdr.isCoachingInvoice").alias("isCoachingInvoice"),
                      cases.alias("_cases"), no_act.alias("_no_act"))
    kept, kept_na = enforce_allowed(F.col("_cases"), F.col("_no_act"), F.col("allowed_valid"))
    extra = [F.col("_cases").alias("corrected_cases"), F.col("_no_act").alias("corrected_no_activity"),
             "allowed_valid"] if keep_corrected else []
    return staged.select("doc_id", "filename", F.col("rec.invoiceHeader").alias("invoiceHeader"),
                         "isCoachingInvoice", kept.alias("clientCases"),
                         kept_na.alias("clientCasesNoActivity"),
                         F.col("rec.needs_ocr").alias("needs_ocr"),
                         F.col("rec.kvk_source").alias("kvk_source"),
                         F.col("rec.vat_source").alias("vat_source"), *extra)


def allowed_long(final: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Long-form allow-list check (J6 / J7): (kept, dropped) rows of doc_id, kind
    (``case`` or ``no_activity``), pos, code for the corrected codes. Both lists and
    the allow-list stand in the document's row, so nothing is joined or shuffled.
    Needs ``final_results(..., keep_corrected=True)``.
    """
    def entries(codes: str, kind: str, code) -> Column:
        return F.transform(codes, lambda c, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"),
                                                        code(c).alias("code")))

    both = F.concat(entries("corrected_cases", "case", lambda c: c["validatedClientCaseNumber"]),
                    entries("corrected_no_activity", "no_activity", lambda c: c))
    rows = (final.select("doc_id", "allowed_valid", F.explode_outer(both).alias("x"))
            .where(F.col("x").isNotNull()).select("doc_id", "allowed_valid", "x.*"))
    allowed = F.coalesce(F.array_contains("allowed_valid", F.col("code")), F.lit(False))
    return rows.where(allowed).drop("allowed_valid"), rows.where(~allowed).drop("allowed_valid")


def result_metrics() -> list[Column]:
    """Run totals over the final results."""
    return [F.count(F.lit(1)).alias("n_results"), F.sum(F.size("clientCases")).alias("n_cases"),
            F.avg(F.size("clientCases")).alias("avg_cases"),
            F.sum(F.size("clientCasesNoActivity")).alias("n_no_activity")]


def result_json(final: DataFrame) -> DataFrame:
    """(output file name, JSON text with nulls written) per result."""
    body = F.to_json(F.struct("invoiceHeader", "isCoachingInvoice", "clientCases",
                              "clientCasesNoActivity"), {"ignoreNullFields": "false"})
    return final.select("doc_id", F.replace(F.col("filename"), F.lit(".pdf"),
                                            F.lit("_parsed.json")).alias("output_file"),
                        body.alias("json"))
