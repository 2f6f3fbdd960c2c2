"""Oracle SQL per registered query (DuckDB dialect); see ``invoxa.plans.oracle``."""

from __future__ import annotations

from invoxa.plans.oracle import MATCHES, PATTERNS, REF, TEXT, lit, patterns_cte, with_

ORACLE: dict[str, str] = {}


def _family(family: str) -> str:
    col = family
    return with_(PATTERNS, f"""
SELECT doc_id, CAST(generate_subscripts({col}, 1) - 1 AS INTEGER) AS pos, unnest({col}) AS value
FROM pat_x""")


ORACLE["ref_codes"] = with_(REF, "SELECT code, canon FROM ref_codes")
ORACLE["ref_canon"] = with_(REF, "SELECT canon, array_to_string(candidates, '|') AS candidates, "
                                 "CAST(n AS BIGINT) AS n FROM ref_canon")
ORACLE["assemble_text"] = with_(TEXT, """
SELECT doc_id, extractor, text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 50 AS text_ok
FROM asm""")
ORACLE["text_fallback"] = with_(TEXT, """
SELECT doc_id, filename, text, extraction_method, error_message, CAST(length(text) AS INTEGER) AS text_length
FROM docs""")
for _f in ("client_cases", "invoice_numbers", "dates_raw", "dates", "amounts", "emails",
           "vat_numbers", "kvk_numbers"):
    ORACLE[f"extract_{_f}"] = ORACLE[f"paged_{_f}"] = _family(_f)
ORACLE["paged_state"] = with_(TEXT, """
SELECT doc_id, filename, extraction_method, error_message, CAST(length(text) AS INTEGER) AS text_length
FROM docs""")

ORACLE["extract_emails_documents"] = with_(
    "docsrc AS (SELECT doc_id, text FROM documents)," + patterns_cte("docsrc"), """
SELECT doc_id, CAST(generate_subscripts(emails, 1) - 1 AS INTEGER) AS pos, unnest(emails) AS value
FROM pat_x""")
ORACLE["header_fields_documents"] = with_(
    "docsrc AS (SELECT doc_id, text FROM documents)," + patterns_cte("docsrc"), """
SELECT doc_id, kvk_numbers[1] AS kvkNumber, vat_numbers[1] AS vatNumber,
       invoice_numbers[1] AS invoiceNumber
FROM pat_x""")

ORACLE["match_cases"] = with_(MATCHES, """
SELECT doc_id, CAST(case_pos AS INTEGER) AS case_pos, raw_code, matched_code, match_status,
       match_confidence, contamination, array_to_string(candidates, '|') AS candidates, notes
FROM matches""")
ORACLE["verdict_counts"] = with_(MATCHES, """
SELECT doc_id, CAST(n_exact AS INTEGER) AS n_exact, CAST(n_fuzzy AS INTEGER) AS n_fuzzy,
       CAST(n_unknown AS INTEGER) AS n_unknown, CAST(n_ambiguous AS INTEGER) AS n_ambiguous
FROM p1f""")
ORACLE["doc_verdict"] = with_(MATCHES, "SELECT doc_id, filename, verdict, reason FROM p1f")
ORACLE["verdict_no_registry"] = with_(PATTERNS, f"""
SELECT doc_id, 'reject' AS verdict, {lit('No clientCaseNumbers found; likely not a coaching invoice')}
       AS reason, false AS ready_for_llm
FROM pat_x""")
ORACLE["doc_confidence"] = with_(MATCHES, """
SELECT doc_id, is_coaching_invoice, confidence_score, ready_for_llm FROM p1f""")
ORACLE["doc_summary"] = with_(MATCHES, """
SELECT doc_id, filename, CAST(text_length AS INTEGER) AS text_length, extraction_method,
       CAST(len(client_cases) AS INTEGER) AS client_cases_found,
       array_to_string(client_cases, '|') AS all_case_numbers,
       array_to_string(invoice_numbers, '|') AS invoice_numbers,
       CAST(len(amounts) AS INTEGER) AS amounts_found, list_max(amounts) AS max_amount,
       confidence_score, error_message IS NOT NULL AS has_error
FROM p1f""")
ORACLE["header_hints"] = with_(MATCHES, """
SELECT doc_id, kvk_numbers[1] AS kvk, vat_numbers[1] AS vat, invoice_numbers[1] AS invoice_number,
       dates[1] AS invoice_date
FROM p1f""")
ORACLE["metadata_record"] = with_(MATCHES, """
SELECT doc_id, filename, CAST(text_length AS INTEGER) AS text_length, extraction_method,
       confidence_score, kvk_numbers[1] AS kvk, vat_numbers[1] AS vat,
       invoice_numbers[1] AS invoice_number, dates[1] AS invoice_date, verdict,
       CASE WHEN text_length > 0 AND len(client_cases) > 0 THEN CAST(len(client_cases) AS INTEGER) END
         AS n_matches,
       'raw_texts/' || replace(filename, '.pdf', '_raw.txt') AS raw_text_file,
       CASE WHEN text_length > 0 THEN left(text, 500) END AS text_preview
FROM p1f""")
ORACLE["metadata_matches"] = with_(MATCHES, """
SELECT m.doc_id, raw_code, matched_code, match_status, match_confidence, contamination,
       array_to_string(candidates, '|') AS candidates, notes
FROM matches m JOIN p1f USING (doc_id) WHERE text_length > 0""")
ORACLE["manifest_rows"] = with_(MATCHES, """
SELECT filename, confidence_score AS confidence, is_coaching_invoice,
       verdict AS client_case_verdict, reason AS client_case_reason, ready_for_llm
FROM p1f""")
ORACLE["manifest_rollup"] = with_(MATCHES, """
SELECT count(*) AS total_invoices, count(*) FILTER (WHERE ready_for_llm) AS ready_invoices,
       count(*) FILTER (WHERE is_coaching_invoice) AS coaching_invoices FROM p1f""")
ORACLE["run_report"] = with_(MATCHES, """
SELECT count(*) AS total, count(*) FILTER (WHERE text_length > 0) AS successful,
       avg(text_length) AS avg_text_length, avg(confidence_score) AS avg_confidence,
       count(*) FILTER (WHERE len(client_cases) > 0) AS with_cases,
       count(*) FILTER (WHERE len(amounts) > 0) AS with_amounts
FROM p1f""")
ORACLE["case_preview"] = with_(MATCHES, """
SELECT doc_id,
       CASE WHEN len(client_cases) = 0 THEN NULL
            WHEN len(client_cases) > 5 THEN array_to_string(client_cases[1:5], ', ') || ' ... and '
                 || CAST(len(client_cases) - 5 AS VARCHAR) || ' more'
            ELSE array_to_string(client_cases, ', ') END AS preview
FROM p1f""")
ORACLE["verdict_label"] = with_(MATCHES, """
SELECT doc_id, CASE WHEN upper(verdict) = 'ACCEPT' THEN 'green'
                    WHEN upper(verdict) = 'NEEDS_REVIEW' THEN 'amber' ELSE 'red' END AS label
FROM p1f""")
ORACLE["raw_text_envelope"] = with_(TEXT, """
SELECT doc_id, 'raw_texts/' || replace(filename, '.pdf', '_raw.txt') AS raw_text_file,
       '=== RAW TEXT EXTRACTION ===' || chr(10) || 'Source: ' || filename || chr(10)
       || 'Extraction Date: 1970-01-01T00:00:00' || chr(10) || repeat('=', 60) || chr(10) || chr(10)
       || text AS content
FROM docs""")
ORACLE["doc_context"] = with_(MATCHES, """
SELECT doc_id, filename, array_to_string(allowed_prompt, '|') AS allowed_prompt,
       array_to_string(allowed_valid, '|') AS allowed_valid,
       array_to_string(list_transform(list_zip(allowed_prompt, allowed_valid),
                                      lambda e: e[1] || '=' || e[2]), '|') AS correction_pairs
FROM p1f""")

# ------------------------------------------------------------------ phase 2
from invoxa.operators.lines import LINE_PATTERN  # noqa: E402
from invoxa.plans.oracle import (FX_RESPONSES, PHASE2, PHASE3, answer, carve,  # noqa: E402
                                 float_val, header_ok, iso_date, lines_ok)

_RESP = FX_RESPONSES
ORACLE["carve_json"] = with_(_RESP, f"SELECT doc_id, agent, attempt, {carve('response_text')} AS carved "
                                    "FROM fx_responses")
ORACLE["classify_attempts"] = with_(PHASE2, "SELECT doc_id, agent, attempt, cls FROM cls")
ORACLE["resolve_attempts"] = with_(PHASE2, """
SELECT d.doc_id,
       EXISTS (SELECT 1 FROM won w WHERE w.doc_id = d.doc_id AND w.agent = 'header') AS header_resolved,
       EXISTS (SELECT 1 FROM won w WHERE w.doc_id = d.doc_id AND w.agent = 'lines') AS lines_resolved,
       EXISTS (SELECT 1 FROM won w WHERE w.doc_id = d.doc_id AND w.agent = 'header_recovery')
         AS recovery_resolved
FROM (SELECT DISTINCT doc_id FROM cls) d""")
ORACLE["resolved_header"] = with_(PHASE2, """
SELECT doc_id, h_supplierName AS supplierName, h_invoiceNumber AS invoiceNumber, h_invoiceDate AS invoiceDate,
       h_kvkNumber AS kvkNumber, h_vatNumber AS vatNumber, coaching AS isCoachingInvoice
FROM hdr""")
ORACLE["recovery_source"] = with_(PHASE2, "SELECT doc_id, " + ", ".join(f"""
       CASE WHEN tier2 AND coalesce(r_{n}, '') <> '' THEN 'recovery'
            WHEN coalesce({n}1, '') <> '' AND {n}1 IS DISTINCT FROM h_{n}Number THEN 'ocr_regex'
            WHEN coalesce({n}1, '') <> '' THEN 'model' END AS {n}_source""" for n in ("kvk", "vat")) + """
FROM f4""")
ORACLE["validate_header"] = with_(_RESP + f""",
v0 AS (SELECT doc_id, attempt, {answer('response_text')} AS c0 FROM fx_responses
      WHERE agent = 'header' AND response_text IS NOT NULL),
v AS (SELECT doc_id, attempt, CASE WHEN json_valid(c0) THEN c0 END AS c FROM v0),
v2 AS (SELECT *, coalesce({header_ok('c')}, false) AS valid FROM v)""", """
SELECT doc_id, attempt, valid,
       CASE WHEN valid THEN json_extract_string(c, '$.invoiceHeader.supplierName') END AS supplierName,
       CASE WHEN valid THEN json_extract_string(c, '$.invoiceHeader.invoiceNumber') END AS invoiceNumber,
       CASE WHEN valid THEN json_extract_string(c, '$.invoiceHeader.invoiceDate') END AS invoiceDate,
       CASE WHEN valid THEN json_extract_string(c, '$.invoiceHeader.kvkNumber') END AS kvkNumber,
       CASE WHEN valid THEN json_extract_string(c, '$.invoiceHeader.vatNumber') END AS vatNumber,
       CASE WHEN valid THEN json_extract_string(c, '$.isCoachingInvoice') = 'true' END AS isCoachingInvoice
FROM v2""")
ORACLE["validate_lines"] = with_(_RESP + f""",
v0 AS (SELECT doc_id, attempt, {answer('response_text')} AS c0 FROM fx_responses
      WHERE agent = 'lines' AND response_text IS NOT NULL),
v AS (SELECT doc_id, attempt, CASE WHEN json_valid(c0) THEN c0 END AS c FROM v0),
v2 AS (SELECT *, coalesce({lines_ok('c')}, false) AS valid FROM v)""", """
SELECT doc_id, attempt, valid,
       CASE WHEN valid THEN CAST(len(coalesce(json_extract(c, '$.clientCases[*]'), [])) AS INTEGER) END
         AS n_cases,
       CASE WHEN valid THEN array_to_string(list_transform(coalesce(json_extract(c,
         '$.clientCasesNoActivity[*]'), []), lambda x: json_extract_string(x, '$')), '|') END AS no_activity
FROM v2""")
ORACLE["validate_line_items"] = with_(_RESP + f""",
v0 AS (SELECT doc_id, attempt, {answer('response_text')} AS c0 FROM fx_responses
      WHERE agent = 'lines' AND response_text IS NOT NULL),
v AS (SELECT doc_id, attempt, CASE WHEN json_valid(c0) THEN c0 END AS c FROM v0),
v2 AS (SELECT doc_id, attempt, coalesce(json_extract(c, '$.clientCases[*]'), []) AS es FROM v
       WHERE coalesce({lines_ok('c')}, false)),
v3 AS (SELECT doc_id, attempt, CAST(generate_subscripts(es, 1) - 1 AS INTEGER) AS pos, unnest(es) AS e FROM v2)""", f"""
SELECT doc_id, attempt, pos, json_extract_string(e, '$.validatedClientCaseNumber') AS validated,
       json_extract_string(e, '$.rawClientCaseNumber') AS raw, json_extract_string(e, '$.date') AS date,
       {float_val('e', '$.durationHours')} AS hours
FROM v3""")
ORACLE["needs_ocr"] = with_(PHASE2, "SELECT doc_id, needs_ocr FROM final")
ORACLE["recover_header"] = with_(PHASE2, "SELECT doc_id, kvkNumber, vatNumber FROM final")
ORACLE["final_results"] = with_(PHASE2, """
SELECT doc_id, filename, supplierName, invoiceNumber, invoiceDate, kvkNumber, vatNumber,
       isCoachingInvoice, CAST(len(cases) AS INTEGER) AS n_cases, array_to_string(na, '|') AS no_activity
FROM final""")
ORACLE["final_cases"] = with_(PHASE2, """
SELECT doc_id, CAST(generate_subscripts(cases, 1) - 1 AS INTEGER) AS pos,
       unnest(list_transform(cases, lambda c: c.v)) AS validated,
       unnest(list_transform(cases, lambda c: c.r)) AS raw,
       unnest(list_transform(cases, lambda c: c.d)) AS date,
       unnest(list_transform(cases, lambda c: c.h)) AS hours
FROM final""")
_CORR = PHASE2 + """,
corr_long AS (
  SELECT doc_id, 'case' AS kind, CAST(generate_subscripts(fixed, 1) - 1 AS INTEGER) AS pos,
         unnest(list_transform(fixed, lambda c: c.v)) AS code, allowed_valid FROM f5
  UNION ALL
  SELECT doc_id, 'no_activity', CAST(generate_subscripts(na2, 1) - 1 AS INTEGER), unnest(na2), allowed_valid
  FROM f5)"""
ORACLE["enforce_allowed"] = with_(_CORR, "SELECT doc_id, kind, pos, code FROM corr_long "
                                         "WHERE list_contains(allowed_valid, code)")
ORACLE["dropped_codes"] = with_(_CORR, "SELECT doc_id, kind, pos, code FROM corr_long "
                                       "WHERE NOT list_contains(allowed_valid, code)")

# ------------------------------------------------------------------ phase 3
ORACLE["eval_docs"] = with_(PHASE3, """
SELECT truth_file, output_file, evaluated, CASE WHEN evaluated THEN points END AS points,
       CASE WHEN evaluated THEN (CAST(points AS DOUBLE) / 7) * 100 END AS accuracy
FROM ev""")
ORACLE["eval_fields"] = with_(PHASE3, """
SELECT truth_file, f_supplierName, f_invoiceNumber, f_invoiceDate, f_kvkNumber, f_vatNumber,
       line_items_ok, no_activity_ok
FROM ev WHERE evaluated""")
ORACLE["eval_missing"] = with_(PHASE3, "SELECT truth_file, output_file FROM ev WHERE NOT evaluated")
ORACLE["eval_final"] = with_(PHASE3, """
SELECT count(*) AS n_evaluated, avg((CAST(points AS DOUBLE) / 7) * 100) AS final_score
FROM ev WHERE evaluated""")
ORACLE["eval_by_field"] = with_(PHASE3, """
SELECT field, avg(CAST(ok AS DOUBLE)) AS accuracy, count(*) AS n FROM (
  UNPIVOT (SELECT f_supplierName, f_invoiceNumber, f_invoiceDate, f_kvkNumber, f_vatNumber,
                  line_items_ok, no_activity_ok FROM ev WHERE evaluated)
  ON f_supplierName, f_invoiceNumber, f_invoiceDate, f_kvkNumber, f_vatNumber, line_items_ok,
     no_activity_ok INTO NAME field VALUE ok)
GROUP BY field""")
ORACLE["eval_case_diff"] = with_(PHASE3, """
SELECT truth_file, array_to_string(missing_codes, '|') AS missing_codes,
       array_to_string(unexpected_codes, '|') AS unexpected_codes
FROM ev WHERE evaluated""")


def _pyset(l: str) -> str:
    return (f"CASE WHEN len({l}) = 0 THEN 'set()' ELSE '{{' || "
            f"array_to_string(list_transform(list_sort({l}), lambda x: '''' || x || ''''), ', ') || '}}' END")


_FIELDS = ("invoiceNumber", "invoiceDate", "supplierName", "kvkNumber", "vatNumber")
_REPORT = ", ".join(
    f"CASE WHEN NOT f_{f} THEN '❌ {f} mismatch: Expected ''' || coalesce(t_{f}, 'None') || "
    f"''', got ''' || coalesce(g_{f}, 'None') || '''' END" for f in _FIELDS)
ORACLE["eval_report"] = with_(PHASE3, f"""
SELECT truth_file, array_to_string(list_filter([{_REPORT},
  CASE WHEN NOT line_items_ok THEN '❌ Line Items mismatch. Missing: ' || {_pyset('missing_codes')}
       || ', Unexpected: ' || {_pyset('unexpected_codes')} END,
  CASE WHEN NOT no_activity_ok THEN '❌ NoActivity mismatch.' END], lambda x: x IS NOT NULL), chr(10))
  AS report
FROM ev WHERE evaluated""")

# ------------------------------------------------------------------ line rules
_LINES = TEXT + f""",
ln0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no
        FROM docs),
ln1 AS (SELECT doc_id, line_no,
               regexp_extract(line, {lit(LINE_PATTERN)}, 1) AS code,
               regexp_extract(line, {lit(LINE_PATTERN)}, 2) AS d,
               regexp_extract(line, {lit(LINE_PATTERN)}, 3) AS v,
               regexp_extract(line, {lit(LINE_PATTERN)}, 4) AS unit
        FROM ln0 WHERE regexp_matches(line, {lit(LINE_PATTERN)})),
ln AS (SELECT doc_id, line_no, code, {iso_date('d')} AS date,
              CASE WHEN lower(unit) IN ('min', 'minuten', 'minute', 'minutes')
                   THEN TRY_CAST(replace(v, ',', '.') AS DOUBLE) / 60.0
                   ELSE TRY_CAST(replace(v, ',', '.') AS DOUBLE) END AS hours
       FROM ln1)"""
ORACLE["line_items_regex"] = with_(_LINES, "SELECT doc_id, line_no, code, date, hours FROM ln")
ORACLE["hours_by_case_date"] = with_(_LINES, """
SELECT doc_id, code, date, sum(hours) AS hours, count(*) AS n_lines FROM ln GROUP BY doc_id, code, date""")

ORACLE["result_json"] = with_(PHASE2, """
SELECT doc_id, replace(filename, '.pdf', '_parsed.json') AS output_file,
       CAST(to_json({'invoiceHeader': {'supplierName': supplierName, 'invoiceNumber': invoiceNumber,
                                       'invoiceDate': invoiceDate, 'kvkNumber': kvkNumber,
                                       'vatNumber': vatNumber},
                     'isCoachingInvoice': isCoachingInvoice,
                     'clientCases': list_transform(cases, lambda c: {'validatedClientCaseNumber': c.v,
                         'rawClientCaseNumber': c.r, 'date': c.d, 'durationHours': c.h}),
                     'clientCasesNoActivity': na}) AS VARCHAR) AS json
FROM final""")

# ------------------------------------------------------------------ prompts, rollup
_SAVED = ("'=== RAW TEXT EXTRACTION ===' || chr(10) || 'Source: ' || filename || chr(10) || "
          "'Extraction Date: 1970-01-01T00:00:00' || chr(10) || repeat('=', 60) || chr(10) || chr(10) || text")
ORACLE["prompts"] = with_(MATCHES, f"""
SELECT doc_id,
       'Extract the invoice header as JSON.' || chr(10) || 'HINTS:' || chr(10) || '- KVK: '
       || coalesce(kvk_numbers[1], 'None') || chr(10) || '- VAT: ' || coalesce(vat_numbers[1], 'None')
       || chr(10) || '- Date: ' || coalesce(dates[1], 'None') || chr(10) || '- Invoice number: '
       || coalesce(invoice_numbers[1], 'None') || chr(10) || 'TEXT:' || chr(10) || {_SAVED} AS header_prompt,
       'Extract the billable line items as JSON.' || chr(10) || 'ALLOWED CASES:' || chr(10)
       || CASE WHEN len(allowed_prompt) > 0 THEN array_to_string(allowed_prompt, chr(10))
               ELSE '(No allowed cases provided)' END || chr(10) || 'TEXT:' || chr(10) || {_SAVED} AS line_prompt
FROM p1f WHERE is_coaching_invoice AND ready_for_llm AND length(filename) > 0""")
ORACLE["recovery_prompts"] = with_(PHASE2, """
SELECT doc_id,
       'Recover the missing header fields from the OCR text.' || chr(10) || 'MISSING:' || chr(10)
       || CASE WHEN coalesce(kvk1, '') = '' THEN '- KvK Number' || chr(10) ELSE '' END
       || CASE WHEN coalesce(vat1, '') = '' THEN '- VAT Number' || chr(10) ELSE '' END
       || 'KNOWN: supplierName=' || coalesce(h_supplierName, 'None') || ', invoiceNumber='
       || coalesce(h_invoiceNumber, 'None') || ', invoiceDate=' || coalesce(h_invoiceDate, 'None')
       || ', isCoachingInvoice=' || CASE WHEN coaching THEN 'true' ELSE 'false' END || chr(10)
       || 'OCR TEXT:' || chr(10) || ocr_text AS recovery_prompt
FROM f2 WHERE ocr_ok AND (coalesce(kvk1, '') = '' OR coalesce(vat1, '') = '')""")
ORACLE["results_rollup"] = with_(PHASE2, """
SELECT count(*) AS n_results, sum(len(cases)) AS n_cases, avg(len(cases)) AS avg_cases,
       sum(len(na)) AS n_no_activity
FROM final""")
ORACLE["work_list"] = with_(MATCHES, f"""
SELECT filename, {_SAVED} AS raw_text, kvk_numbers[1] AS kvk, vat_numbers[1] AS vat, dates[1] AS invoice_date,
       invoice_numbers[1] AS invoice_number, array_to_string(allowed_prompt, '|') AS allowed_prompt,
       array_to_string(allowed_valid, '|') AS allowed_valid,
       array_to_string(list_transform(list_zip(allowed_prompt, allowed_valid),
                                      lambda e: e[1] || '=' || e[2]), '|') AS correction_pairs
FROM p1f WHERE is_coaching_invoice AND ready_for_llm AND length(filename) > 0""")


def _totals(phase: str, sql: str, columns: tuple[str, ...]) -> str:
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    return (f"SELECT '{phase}' AS phase, metric, value FROM "
            f"(UNPIVOT (SELECT {doubles} FROM ({sql})) ON COLUMNS(*) INTO NAME metric VALUE value)")


ORACLE["run_totals"] = "\nUNION ALL\n".join((
    _totals("documents", ORACLE["run_report"], ("total", "successful", "avg_text_length", "avg_confidence",
                                                "with_cases", "with_amounts")),
    _totals("results", ORACLE["results_rollup"], ("n_results", "n_cases", "avg_cases", "n_no_activity"))))
ORACLE["match_cases_once"] = ORACLE["match_cases"]
