"""DuckDB SQL for the correctness gate.

An independent rendering of the same fixture recipe and operators in DuckDB
SQL over the driver's views (orders, lineitem, part, documents, ...). It
shares only fixed values (patterns, month names, texts) with the Spark code;
the expressions are written separately and use DuckDB's own functions
(``try_strptime``, ``string_agg``, list lambdas, ``json_type``...).
"""

from __future__ import annotations

from invoxa.functions.codes import (NOTE_AMBIGUOUS, NOTE_EMPTY, NOTE_FUZZY,
                                    NOTE_UNREGISTERED)
from invoxa.functions.patterns import (MONTHS_NL, PATTERN_FAMILIES, VAT_EU_GENERIC,
                                       VAT_LABEL_PREFIX, VAT_NL_CANON)
from invoxa.operators.matching import (REASON_ACCEPT, REASON_NO_CODES, REASON_REJECT,
                                       REASON_REVIEW)

NL = "chr(10)"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pad(x: str, n: int) -> str:
    return f"lpad({s_(x)}, CAST(greatest({n}, length({s_(x)})) AS INTEGER), '0')"


def s_(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


def grouped(u: str, sep: str) -> str:
    return (f"CASE WHEN {u} < 1000 THEN {s_(u)} "
            f"WHEN {u} < 1000000 THEN {s_(f'{u} // 1000')} || '{sep}' || {pad(f'{u} % 1000', 3)} "
            f"ELSE {s_(f'{u} // 1000000')} || '{sep}' || {pad(f'({u} // 1000) % 1000', 3)} || '{sep}' "
            f"|| {pad(f'{u} % 1000', 3)} END")


def eu(x: str) -> str:
    c = f"CAST(round({x} * 100) AS BIGINT)"
    return f"({grouped(f'({c} // 100)', '.')} || ',' || {pad(f'{c} % 100', 2)})"


def us(x: str) -> str:
    c = f"CAST(round({x} * 100) AS BIGINT)"
    return f"({grouped(f'({c} // 100)', ',')} || '.' || {pad(f'{c} % 100', 2)})"


MONTHS = "[" + ", ".join(lit(m) for m in MONTHS_NL) + "]"


def raw_code(o: str, pk: str) -> str:
    num = pad(pk, 3)
    num = f"(CASE WHEN {o} % 11 = 2 THEN translate({num}, '1', 'I') ELSE {num} END)"
    code = f"(CASE WHEN {o} % 7 = 1 THEN 'DEM0' ELSE 'DEMO' END || '-CASE-' || {num})"
    return f"(CASE WHEN {o} % 29 = 6 THEN lower({code}) ELSE {code} END)"


def clean_code(pk: str) -> str:
    return f"('DEMO-CASE-' || {pad(pk, 3)})"


def hours_text(q: str) -> str:
    h = f"(CAST({q} AS INTEGER) % 4)"
    return f"({s_(f'{h} // 2')} || CASE WHEN {h} % 2 = 1 THEN '.5' ELSE '' END)"


def filename(o: str) -> str:
    return f"('inv_' || {pad(o, 8)} || '.pdf')"


# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------

FX_FACTS = """
fx_li AS (
  SELECT l_orderkey AS doc_id, l_partkey, l_quantity, l_extendedprice, l_shipdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice, l_shipdate, l_quantity) AS ln
  FROM lineitem),
fx_orders AS (
  SELECT o_orderkey AS doc_id, o_custkey AS cust, o_orderdate AS odate, o_totalprice AS total
  FROM orders WHERE o_orderkey IN (SELECT doc_id FROM fx_li))"""


def _header_page() -> str:
    o, c, d = "o.doc_id", "o.cust", "o.odate"
    num = s_(f"{o} + 100000")
    number = (f"CASE WHEN {o} % 19 = 3 THEN 'Betreft: facturen ' || {num} "
              f"WHEN {o} % 19 = 4 THEN NULL "
              f"WHEN {o} % 19 = 5 THEN 'Factuurnummer:' || {NL} || {num} "
              f"WHEN {o} % 19 = 6 THEN 'Ref: INV-' || {num} "
              f"WHEN {o} % 19 = 7 THEN 'Fact.: ' || {num} || '.A' "
              f"ELSE 'Factuurnummer: ' || {num} END")
    date = (f"CASE WHEN {o} % 4 = 0 THEN strftime({d}, '%d-%m-%Y') "
            f"WHEN {o} % 4 = 1 THEN strftime({d}, '%-d/%-m/%y') "
            f"WHEN {o} % 4 = 2 THEN {s_(f'day({d})')} || ' ' || {MONTHS}[month({d})] || ' ' || {s_(f'year({d})')} "
            f"ELSE strftime({d}, '%Y-%m-%d') END")
    k8 = s_(f"10000000 + ({o} * 7919) % 90000000")
    k7 = s_(f"1000000 + ({o} * 7919) % 9000000")
    kvk = (f"CASE WHEN {o} % 5 = 1 THEN 'KvK: ' || {k8} WHEN {o} % 5 = 2 THEN 'KvK nummer ' || {k8} "
           f"WHEN {o} % 5 = 3 THEN 'KvK-nr. ' || {k8} WHEN {o} % 5 = 4 THEN 'KvK ' || {k7} END")
    v9 = s_(f"100000000 + ({o} * 104729) % 900000000")
    dotted = f"(substr({v9}, 1, 3) || '.' || substr({v9}, 4, 3) || '.' || substr({v9}, 7, 3))"
    vat = (f"CASE WHEN {o} % 6 = 1 THEN 'BTW nr: NL' || {v9} || 'B01' "
           f"WHEN {o} % 6 = 2 THEN 'BTW NL ' || {dotted} || '.B.01' "
           f"WHEN {o} % 6 = 3 THEN 'VAT: DE' || {v9} "
           f"WHEN {o} % 6 = 4 THEN 'btw ' || {v9} || 'B41' "
           f"WHEN {o} % 6 = 5 THEN 'BTW-id: NL' || {v9} || 'B02' END")
    email = f"CASE WHEN {o} % 3 = 0 THEN 'E-mail: billing' || {s_(c)} || '@praktijk.example.com' END"
    due = f"CASE WHEN {o} % 10 = 7 THEN 'Vervaldatum: 31-02-' || {s_(f'year({d})')} END"
    return (f"concat_ws({NL}, 'Supplier#' || {pad(f'{c} % 100', 9)}, 'Aan: Klant ' || {s_(c)}, "
            f"{number}, 'Factuurdatum: ' || ({date}), {due}, {kvk}, {vat}, {email})")


def _body_lines() -> str:
    o = "l.doc_id"
    code = f"CASE WHEN {o} % 13 = 0 THEN 'Advies' ELSE {raw_code(o, 'l.l_partkey')} END"
    q = "(CAST(l.l_quantity AS INTEGER) % 4)"
    qty = f"CASE WHEN {o} % 53 = 1 THEN {s_(f'{q} * 30')} || ' min' ELSE {s_(q)} || ' uur' END"
    return (f"({code}) || ' ' || strftime(l.l_shipdate, '%d-%m-%Y') || ' ' || ({qty}) "
            f"|| ' € ' || {eu('l.l_extendedprice')}")


def _total_line() -> str:
    o, t = "o.doc_id", "o.total"
    return (f"CASE WHEN {o} % 8 = 0 THEN 'Totaal: € ' || {eu(t)} "
            f"WHEN {o} % 8 = 1 THEN 'EUR ' || {us(t)} "
            f"WHEN {o} % 8 = 2 THEN 'Bedrag 12,5' WHEN {o} % 8 = 3 THEN 'Total: 99.' "
            f"WHEN {o} % 8 = 5 THEN '$ ' || {us(t)} "
            f"WHEN {o} % 8 = 7 THEN 'Bedrag: 1,23,456' "
            f"ELSE 'Subtotaal: ' || {eu(t)} END")


FX_PAGES = FX_FACTS + f""",
fx_body AS (
  SELECT l.doc_id, string_agg({_body_lines()}, {NL} ORDER BY l.ln) AS body
  FROM fx_li l GROUP BY l.doc_id),
fx_doc AS (
  SELECT o.doc_id, {_header_page()} AS header, b.body || {NL} || ({_total_line()}) AS body
  FROM fx_orders o JOIN fx_body b ON b.doc_id = o.doc_id),
fx_pages_raw AS (
  SELECT doc_id, 'primary' AS extractor, 1 AS page_no,
         CASE WHEN doc_id % 51 = 7 THEN 'scan' WHEN doc_id % 17 = 5 THEN '' ELSE header END AS page_text
  FROM fx_doc
  UNION ALL
  SELECT doc_id, 'primary', 2,
         CASE WHEN doc_id % 17 = 5 OR doc_id % 9 = 4 THEN '' ELSE body END
  FROM fx_doc WHERE doc_id % 51 <> 7
  UNION ALL
  SELECT doc_id, 'primary', 3, body FROM fx_doc
  WHERE doc_id % 9 = 4 AND doc_id % 51 <> 7 AND doc_id % 17 <> 5
  UNION ALL
  SELECT doc_id, 'secondary', 1, CASE WHEN doc_id % 51 = 7 THEN 'scan 001' ELSE header END
  FROM fx_doc WHERE doc_id % 51 = 7 OR doc_id % 17 = 5
  UNION ALL
  SELECT doc_id, 'secondary', 2, CASE WHEN doc_id % 51 = 7 THEN '' ELSE body END
  FROM fx_doc WHERE doc_id % 51 = 7 OR doc_id % 17 = 5),
fx_pages AS (
  SELECT doc_id, {filename('doc_id')} AS filename, extractor, page_no, page_text FROM fx_pages_raw)"""

FX_REGISTRY = f"""
fx_part AS (SELECT p_partkey, {pad('p_partkey', 3)} AS num FROM part WHERE p_partkey % 10 <> 9),
fx_registry AS (
  SELECT 'DEMO-CASE-' || num AS code, p_partkey * 4 + 1 AS place FROM fx_part
  UNION ALL
  SELECT 'DEMO-CASE-I' || substr(num, 2), p_partkey * 4 + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 2 END
  FROM fx_part WHERE num LIKE '1%' AND p_partkey % 3 = 1
  UNION ALL
  SELECT 'DEMO-CASE-' || num, p_partkey * 4 + 3 FROM fx_part WHERE p_partkey % 17 = 3)"""


def canon(x: str) -> str:
    c = f"upper(trim({x}))"
    return (f"(CASE WHEN length({c}) < 11 THEN {c} ELSE substr({c}, 1, 3) || "
            f"translate(substr({c}, 4, 1), 'IO', '10') || substr({c}, 5, 6) || "
            f"translate(substr({c}, 11, 3), 'IO', '10') || substr({c}, 14) END)")


def contamination(x: str) -> str:
    u = f"upper({x})"
    return (f"(CASE WHEN NOT contains({u}, 'I') AND NOT contains({u}, 'O') THEN 'none' "
            f"WHEN contains({u}, 'I') AND contains({u}, 'O') THEN 'I_and_O' "
            f"WHEN contains({u}, 'I') THEN 'I_only' ELSE 'O_only' END)")


REF = FX_REGISTRY + f""",
ref_codes AS (SELECT trim(code) AS code, {canon('code')} AS canon, place FROM fx_registry WHERE trim(code) <> ''),
ref_canon AS (SELECT canon, list(code ORDER BY place) AS candidates, count(*) AS n
              FROM ref_codes GROUP BY canon)"""


# ---------------------------------------------------------------------------
# Text, patterns
# ---------------------------------------------------------------------------

def _marker_agg() -> str:
    return (f"coalesce(string_agg({NL} || '--- Page ' || CAST(page_no AS VARCHAR) || ' ---' || {NL} "
            f"|| page_text || {NL}, '' ORDER BY page_no) FILTER (WHERE length(page_text) > 0), '')")


def ok(t: str) -> str:
    return f"(length(regexp_replace({t}, '^\\s+|\\s+$', '', 'g')) > 50)"


TEXT = FX_PAGES + f""",
asm AS (
  SELECT doc_id, extractor, {_marker_agg()} AS text FROM fx_pages GROUP BY doc_id, extractor),
docs_text AS (
  SELECT d.doc_id, d.filename,
         coalesce(p.text, '') AS t1, coalesce(s.text, '') AS t2
  FROM (SELECT DISTINCT doc_id, filename FROM fx_pages) d
  LEFT JOIN asm p ON p.doc_id = d.doc_id AND p.extractor = 'primary'
  LEFT JOIN asm s ON s.doc_id = d.doc_id AND s.extractor = 'secondary'),
docs AS (
  SELECT doc_id, filename,
         CASE WHEN {ok('t1')} THEN t1 ELSE t2 END AS text,
         CASE WHEN {ok('t1')} OR {ok('t2')} THEN 'pdf_text_extraction' ELSE 'extraction_failed' END
           AS extraction_method,
         CASE WHEN {ok('t1')} OR {ok('t2')} THEN NULL ELSE 'Failed to extract text' END AS error_message
  FROM docs_text)"""


def family_raw(text: str, family: str) -> str:
    parts = [f"regexp_extract_all({text}, {lit(p)}, {g})" for p, g in PATTERN_FAMILIES[family]]
    return parts[0] if len(parts) == 1 else "list_concat(" + ", ".join(parts) + ")"


def dd(l: str) -> str:
    """Order-keeping distinct of non-blank strings (first occurrence wins)."""
    return f"list_filter({l}, lambda x, i: x <> '' AND list_position({l}, x) = i)"


def dd_any(l: str) -> str:
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def amount(s: str) -> str:
    lc = f"(length({s}) - strpos(reverse({s}), ',') + 1)"
    ld = f"(length({s}) - strpos(reverse({s}), '.') + 1)"
    return (f"TRY_CAST(CASE WHEN contains({s}, ',') AND contains({s}, '.') THEN "
            f"CASE WHEN {lc} > {ld} THEN replace(replace({s}, '.', ''), ',', '.') "
            f"ELSE replace({s}, ',', '') END "
            f"WHEN contains({s}, ',') THEN CASE WHEN length(split_part({s}, ',', 2)) = 2 "
            f"THEN replace({s}, ',', '.') ELSE replace({s}, ',', '') END ELSE {s} END AS DOUBLE)")


def vat_clean(s: str) -> str:
    return (f"regexp_replace(regexp_replace(upper({s}), '[\\s.\\-]', '', 'g'), "
            f"{lit(VAT_LABEL_PREFIX)}, '')")


def vat_value(c: str) -> str:
    return (f"CASE WHEN regexp_full_match({c}, {lit(VAT_NL_CANON[1:-1])}) THEN "
            f"'NL' || substr({c}, 3, 9) || 'B' || right({c}, 2) "
            f"WHEN regexp_full_match({c}, {lit(VAT_EU_GENERIC[1:-1])}) THEN {c} END")


def iso_date(s: str) -> str:
    named = r"\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\s*"
    mon = f"list_position({MONTHS}, lower(regexp_extract({s}, {lit(named)}, 2)))"
    return (
        f"strftime(CASE "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}') THEN try_strptime({s}, '%d-%m-%Y') "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime({s}, '%d/%m/%Y') "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}-\\d{{1,2}}-\\d{{2}}') THEN try_strptime({s}, '%d-%m-%y') "
        f"WHEN regexp_full_match({s}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN try_strptime({s}, '%d/%m/%y') "
        f"WHEN regexp_full_match({s}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({s}, '%Y-%m-%d') "
        f"WHEN regexp_full_match({s}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN try_strptime({s}, '%Y/%m/%d') "
        f"WHEN regexp_full_match({s}, {lit(named)}) AND {mon} > 0 THEN try_strptime("
        f"regexp_extract({s}, {lit(named)}, 3) || '-' || CAST({mon} AS VARCHAR) || '-' || "
        f"regexp_extract({s}, {lit(named)}, 1), '%Y-%m-%d') END, '%Y-%m-%d')")


def patterns_cte(src: str, text: str = "text", key: str = "doc_id", name: str = "pat") -> str:
    """Raw family lists -> cleaned lists, as two CTEs ``{name}_raw`` and ``{name}``."""
    fams = ", ".join(f"CASE WHEN length({text}) > 0 THEN {family_raw(text, f)} ELSE [] END AS r_{f}"
                     for f in PATTERN_FAMILIES)
    return f"""
{name}_raw AS (SELECT *, {fams} FROM {src}),
{name}_1 AS (
  SELECT * EXCLUDE (r_client_cases, r_invoice_numbers, r_dates, r_amounts, r_emails, r_vat_numbers,
                    r_kvk_numbers),
         {dd('r_client_cases')} AS client_cases,
         {dd('r_invoice_numbers')} AS invoice_numbers,
         {dd('r_dates')} AS dates_raw,
         list_filter(list_transform(r_amounts, lambda s: {amount('s')}), lambda x: x IS NOT NULL) AS amounts0,
         {dd('r_emails')} AS emails,
         list_filter(list_transform(list_transform(r_vat_numbers, lambda s: {vat_clean('s')}),
                                    lambda c: {vat_value('c')}), lambda x: x IS NOT NULL) AS vat0,
         {dd('r_kvk_numbers')} AS kvk_numbers
  FROM {name}_raw),
{name} AS (
  SELECT * EXCLUDE (amounts0, vat0),
         list_filter(list_transform(dates_raw, lambda s: {iso_date('s')}), lambda x: x IS NOT NULL) AS dates0,
         {dd_any('amounts0')} AS amounts, {dd_any('vat0')} AS vat_numbers
  FROM {name}_1),
{name}_x AS (SELECT * EXCLUDE (dates0), {dd_any('dates0')} AS dates FROM {name})"""


PATTERNS = TEXT + "," + patterns_cte("docs")


def match_select(code: str) -> str:
    """Columns of the match record for a stripped code ``code`` joined with
    ``e`` (exact) and ``r`` (ref_canon)."""
    n = "coalesce(r.n, 0)"
    return f"""
    CASE WHEN {code} = '' THEN NULL WHEN e.code IS NOT NULL THEN {code}
         WHEN {n} = 1 THEN r.candidates[1] END AS matched_code,
    CASE WHEN {code} = '' THEN 'unknown' WHEN e.code IS NOT NULL THEN 'exact'
         WHEN {n} = 0 THEN 'unknown' WHEN {n} = 1 THEN 'fuzzy_io_swap' ELSE 'ambiguous_io_swap' END
      AS match_status,
    CASE WHEN {code} = '' THEN 0.0 WHEN e.code IS NOT NULL THEN 1.0
         WHEN {n} = 0 THEN 0.0 WHEN {n} = 1 THEN 0.75 ELSE 0.3 END::DOUBLE AS match_confidence,
    CASE WHEN {code} = '' THEN 'none' WHEN e.code IS NOT NULL THEN {contamination(code)}
         WHEN {n} = 0 THEN {contamination(code)} WHEN {n} = 1 THEN {contamination('r.candidates[1]')}
         ELSE 'none' END AS contamination,
    CASE WHEN {code} = '' THEN [] WHEN e.code IS NOT NULL THEN [{code}]
         WHEN {n} = 0 THEN [] ELSE r.candidates END AS candidates,
    CASE WHEN {code} = '' THEN {lit(NOTE_EMPTY)} WHEN e.code IS NOT NULL THEN NULL
         WHEN {n} = 0 THEN {lit(NOTE_UNREGISTERED)} WHEN {n} = 1 THEN {lit(NOTE_FUZZY)}
         ELSE {lit(NOTE_AMBIGUOUS)} END AS notes"""


MATCHES = PATTERNS + "," + REF + f""",
codes AS (
  SELECT doc_id, unnest(client_cases) AS raw_code,
         generate_subscripts(client_cases, 1) - 1 AS case_pos FROM pat_x),
matches AS (
  SELECT c.doc_id, c.case_pos, c.raw_code, {match_select('trim(c.raw_code)')}
  FROM codes c
  LEFT JOIN (SELECT DISTINCT code FROM ref_codes) e ON e.code = trim(c.raw_code)
  LEFT JOIN ref_canon r ON r.canon = {canon('c.raw_code')}),
counts AS (
  SELECT doc_id,
         count(*) FILTER (WHERE match_status = 'exact') AS n_exact,
         count(*) FILTER (WHERE match_status = 'fuzzy_io_swap') AS n_fuzzy,
         count(*) FILTER (WHERE match_status = 'unknown') AS n_unknown,
         count(*) FILTER (WHERE match_status = 'ambiguous_io_swap') AS n_ambiguous,
         list(raw_code ORDER BY case_pos) FILTER (WHERE match_status IN ('exact', 'fuzzy_io_swap')
                                                   AND matched_code IS NOT NULL) AS allowed_prompt,
         list(matched_code ORDER BY case_pos) FILTER (WHERE match_status IN ('exact', 'fuzzy_io_swap')
                                                       AND matched_code IS NOT NULL) AS allowed_valid
  FROM matches GROUP BY doc_id),
p1 AS (
  SELECT p.*, length(p.text) AS text_length,
         coalesce(c.n_exact, 0) AS n_exact, coalesce(c.n_fuzzy, 0) AS n_fuzzy,
         coalesce(c.n_unknown, 0) AS n_unknown, coalesce(c.n_ambiguous, 0) AS n_ambiguous,
         coalesce(c.allowed_prompt, []) AS allowed_prompt,
         coalesce(c.allowed_valid, []) AS allowed_valid,
         CASE WHEN c.doc_id IS NULL THEN 'reject'
              WHEN c.n_unknown > 0 OR c.n_ambiguous > 0 THEN 'reject'
              WHEN c.n_fuzzy > 0 THEN 'needs_review' ELSE 'accept' END AS verdict,
         CASE WHEN c.doc_id IS NULL THEN {lit(REASON_NO_CODES)}
              WHEN c.n_unknown > 0 OR c.n_ambiguous > 0 THEN {lit(REASON_REJECT)}
              WHEN c.n_fuzzy > 0 THEN {lit(REASON_REVIEW)} ELSE {lit(REASON_ACCEPT)} END AS reason,
         len(p.client_cases) > 0 AS is_coaching_invoice
  FROM pat_x p LEFT JOIN counts c ON c.doc_id = p.doc_id),
p1f AS (
  SELECT *,
    CASE WHEN NOT is_coaching_invoice THEN CASE WHEN text_length > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
    ELSE least(0.4::DOUBLE
         + CASE WHEN len(dates) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN len(amounts) > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN len(invoice_numbers) > 0 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
         + CASE WHEN text_length > 500 THEN 0.1::DOUBLE WHEN text_length > 100 THEN 0.05::DOUBLE
                ELSE 0.0::DOUBLE END, 1.0::DOUBLE) END AS confidence_score,
    is_coaching_invoice AND text_length > 0 AND verdict <> 'reject' AS ready_for_llm
  FROM p1)"""


def with_(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip().lstrip(",") + "\n" + select


# ---------------------------------------------------------------------------
# Phase 2 fixtures: model responses, OCR text; ground truth
# ---------------------------------------------------------------------------

def q_(x: str) -> str:
    return f"('\"' || {x} || '\"')"


def _kvk_value(o: str) -> str:
    k8 = s_(f"10000000 + ({o} * 7919) % 90000000")
    k7 = s_(f"1000000 + ({o} * 7919) % 9000000")
    return f"(CASE WHEN {o} % 5 = 0 THEN NULL WHEN {o} % 5 = 4 THEN {k7} ELSE {k8} END)"


def _vat_value(o: str) -> str:
    v9 = s_(f"100000000 + ({o} * 104729) % 900000000")
    return (f"(CASE WHEN {o} % 6 = 3 THEN 'DE' || {v9} WHEN {o} % 6 = 5 THEN 'NL' || {v9} || 'B02' "
            f"WHEN {o} % 6 IN (1, 2) THEN 'NL' || {v9} || 'B01' END)")


def _wrap(o: str, body: str) -> str:
    return (f"(CASE WHEN {o} % 3 = 1 THEN '```json' || {NL} || {body} || {NL} || '```' "
            f"WHEN {o} % 3 = 2 THEN 'Here is the JSON you asked for:' || {NL} || {body} || {NL} "
            f"|| 'Let me know if you need more.' ELSE {body} END)")


def _tries(x: str) -> str:
    return f"(CASE WHEN {x} BETWEEN 1 AND 4 THEN {x} ELSE 0 END)"


_OVERLOAD = ("(CASE WHEN doc_id % 2 = 0 THEN '503 UNAVAILABLE: The model is overloaded.' "
             "ELSE '429 RESOURCE_EXHAUSTED: quota exceeded' END)")


def _header_json(o: str) -> str:
    kvk = (f"(CASE WHEN {o} % 5 = 0 AND {o} % 10 = 5 THEN '\"\"' "
           f"ELSE coalesce({q_(_kvk_value(o))}, 'null') END)")
    vat = (f"(CASE WHEN {o} % 12 = 6 OR {o} % 6 = 4 THEN '\"\"' "
           f"ELSE coalesce({q_(_vat_value(o))}, 'null') END)")
    num = s_(f"{o} + 100000")
    number = f"(CASE WHEN {o} % 31 = 2 THEN {num} ELSE {q_(num)} END)"
    obj = (f"(CASE WHEN {o} % 31 = 3 THEN 'null' ELSE '{{\"supplierName\": \"Supplier#' || "
           f"{pad(f'o.cust % 100', 9)} || '\", \"invoiceNumber\": ' || {number} || "
           f"', \"invoiceDate\": \"' || strftime(o.odate, '%Y-%m-%d') || '\", \"kvkNumber\": ' || {kvk} "
           f"|| ', \"vatNumber\": ' || {vat} || '}}' END)")
    tail = (f"(CASE WHEN {o} % 31 = 1 THEN '}}' ELSE ', \"isCoachingInvoice\": ' || "
            f"CASE WHEN {o} % 13 = 0 THEN 'false' ELSE 'true' END || '}}' END)")
    start = f"(CASE WHEN {o} % 31 = 5 THEN '{{\"isCoachingInvoice\": \"dup\", \"invoiceHeader\": ' ELSE '{{\"invoiceHeader\": ' END)"
    return f"({start} || {obj} || {tail})"


def _item_json() -> str:
    o = "l.doc_id"
    code = raw_code(o, "l.l_partkey")
    ht = hours_text("l.l_quantity")
    hours = f"(CASE WHEN {o} % 31 = 2 THEN {q_(ht)} ELSE {ht} END)"
    key = f"(CASE WHEN {o} % 31 = 1 THEN '\"caseNumber\": ' ELSE '\"validatedClientCaseNumber\": ' END)"
    return (f"'{{' || {key} || {q_(code)} || ', \"rawClientCaseNumber\": ' || {q_(code)} || "
            f"', \"date\": \"' || strftime(l.l_shipdate, '%Y-%m-%d') || '\"' || "
            f"CASE WHEN {o} % 31 = 5 THEN ', \"durationHours\": 99' ELSE '' END || ', \"durationHours\": ' || {hours} || '}}'")


_EXTRA_ITEM = '{"validatedClientCaseNumber": "DEMO-CASE-999", "date": null, "durationHours": 1}'


def _lines_json(o: str) -> str:
    cases = (f"('[' || concat_ws(', ', CASE WHEN {o} % 13 <> 0 THEN li.items END, "
             f"CASE WHEN {o} % 37 = 4 THEN {lit(_EXTRA_ITEM)} END) || ']')")
    cases = f"(CASE WHEN {o} % 31 = 3 THEN 'null' ELSE {cases} END)"
    no_act = (f"(CASE WHEN {o} % 17 = 3 THEN ', \"clientCasesNoActivity\": [' || {q_('li.first_code')} "
              f"|| ']' WHEN {o} % 2 = 0 THEN ', \"clientCasesNoActivity\": []' ELSE '' END)")
    return f"('{{\"clientCases\": ' || {cases} || {no_act} || '}}')"


def _rec_json(o: str) -> str:
    k8 = s_(f"20000000 + ({o} * 7919) % 80000000")
    v9 = s_(f"100000000 + ({o} * 104729) % 900000000")
    kvk = f"(CASE WHEN {o} % 5 = 0 OR {o} % 2 = 0 THEN {q_(k8)} ELSE 'null' END)"
    nl = f"'NL' || {v9} || 'B07'"
    vat = f"(CASE WHEN {o} % 6 IN (0, 4) OR {o} % 2 = 0 THEN {q_(nl)} ELSE 'null' END)"
    return (f"('{{\"invoiceHeader\": {{\"kvkNumber\": ' || {kvk} || ', \"vatNumber\": ' || {vat} "
            f"|| '}}, \"isCoachingInvoice\": true}}')")


_QUOTED = ("(CASE WHEN agent = 'lines' AND doc_id % 29 = 6 THEN "
           """'{"clientCases": [{"validatedClientCaseNumber": "DEMO-CASE-001", "durationHours": "503 h"}]}' """
           "WHEN agent = 'header' AND doc_id % 29 = 7 THEN "
           """'{"invoiceHeader": {"kvkNumber": [429]}, "isCoachingInvoice": true}' END)""")

_NEEDS = "(doc_id % 5 = 0 OR doc_id % 6 IN (0, 4) OR doc_id % 31 = 3)"

FX_RESPONSES = FX_FACTS + f""",
fx_items AS (
  SELECT l.doc_id, string_agg({_item_json()}, ', ' ORDER BY l.ln) AS items,
         max(CASE WHEN l.ln = 1 THEN {raw_code('l.doc_id', 'l.l_partkey')} END) AS first_code
  FROM fx_li l GROUP BY l.doc_id),
fx_bodies AS (
  SELECT o.doc_id, {_wrap('o.doc_id', _header_json('o.doc_id'))} AS hbody,
         {_wrap('o.doc_id', _lines_json('o.doc_id'))} AS lbody,
         {_rec_json('o.doc_id')} AS rbody
  FROM fx_orders o JOIN fx_items li ON li.doc_id = o.doc_id),
fx_calls AS (
  SELECT doc_id, 'header' AS agent, hbody AS body,
         CASE WHEN doc_id % 23 = 1 THEN 0 ELSE {_tries('doc_id % 10')} END AS k,
         doc_id % 23 = 1 AS other_error, false AS empty FROM fx_bodies
  UNION ALL
  SELECT doc_id, 'lines', lbody,
         CASE WHEN doc_id % 23 = 2 THEN 0 ELSE {_tries('(doc_id // 10) % 10')} END,
         false, doc_id % 23 = 2 FROM fx_bodies
  UNION ALL
  SELECT doc_id, 'header_recovery', rbody, 0, false, false FROM fx_bodies WHERE {_NEEDS}),
fx_attempts AS (SELECT *, unnest(range(0, least(k, 3) + 1)) AS attempt FROM fx_calls),
fx_responses AS (
  SELECT doc_id, agent, CAST(attempt AS INTEGER) AS attempt,
         CASE WHEN attempt < k THEN {_QUOTED} WHEN other_error THEN NULL WHEN empty THEN '' ELSE body END
           AS response_text,
         CASE WHEN attempt < k AND {_QUOTED} IS NULL THEN {_OVERLOAD}
              WHEN other_error THEN '400 INVALID_ARGUMENT: bad request' END AS error
  FROM fx_attempts),
fx_ocr AS (
  SELECT doc_id, {filename('doc_id')} AS filename,
         CASE WHEN doc_id % 3 = 0 THEN 'KvK: ' || {s_('30000000 + (doc_id * 7919) % 70000000')}
                   || {NL} || 'BTW nr: NL' || {s_('100000000 + (doc_id * 104729) % 900000000')} || 'B03'
              WHEN doc_id % 3 = 1 THEN 'Kamer van Koophandel' || {NL} || 'KvK: '
                   || {s_('30000000 + (doc_id * 7919) % 70000000')}
              ELSE '' END AS text
  FROM fx_orders WHERE {_NEEDS} AND doc_id % 7 <> 3)"""

FX_TRUTH = f"""
fx_truth_lines AS (
  SELECT l.doc_id,
         list({clean_code('l.l_partkey')} ORDER BY l.ln) FILTER (WHERE CAST(l.l_quantity AS INTEGER) % 4 <> 0)
           AS codes,
         list({raw_code('l.doc_id', 'l.l_partkey')} ORDER BY l.ln)
           FILTER (WHERE CAST(l.l_quantity AS INTEGER) % 4 <> 0) AS raws,
         list(strftime(l.l_shipdate, '%Y-%m-%d') ORDER BY l.ln)
           FILTER (WHERE CAST(l.l_quantity AS INTEGER) % 4 <> 0) AS dates,
         list(CAST({hours_text('l.l_quantity')} AS DOUBLE) ORDER BY l.ln)
           FILTER (WHERE CAST(l.l_quantity AS INTEGER) % 4 <> 0) AS hours,
         list({clean_code('l.l_partkey')} ORDER BY l.ln) FILTER (WHERE CAST(l.l_quantity AS INTEGER) % 4 = 0)
           AS idle
  FROM fx_li l GROUP BY l.doc_id),
fx_truth AS (
  SELECT o.doc_id, 'inv_' || {pad('o.doc_id', 8)} || '.json' AS filename,
         'Supplier#' || {pad('o.cust % 100', 9)} || CASE WHEN o.doc_id % 41 = 1 THEN ' B.V.' ELSE '' END
           AS t_supplierName,
         CASE WHEN o.doc_id % 19 = 4 THEN NULL ELSE {s_('o.doc_id + 100000')} END AS t_invoiceNumber,
         strftime(o.odate, '%Y-%m-%d') AS t_invoiceDate,
         {_kvk_value('o.doc_id')} AS t_kvkNumber,
         CASE WHEN o.doc_id % 6 IN (0, 4) THEN NULL ELSE {_vat_value('o.doc_id')} END AS t_vatNumber,
         CASE WHEN o.doc_id % 41 = 2 THEN coalesce(t.codes, [])[2:] ELSE coalesce(t.codes, []) END AS t_codes,
         list_sort(list_distinct(coalesce(t.idle, []) ||
           CASE WHEN o.doc_id % 41 = 3 THEN ['DEMO-CASE-998'] ELSE [] END)) AS t_na
  FROM fx_orders o LEFT JOIN fx_truth_lines t ON t.doc_id = o.doc_id
  WHERE o.doc_id % 13 <> 0)"""


# ---------------------------------------------------------------------------
# Phase 2 operators
# ---------------------------------------------------------------------------

def carve(s: str) -> str:
    t = f"regexp_replace({s}, '^\\s+|\\s+$', '', 'g')"
    st = f"strpos({t}, '{{')"
    en = f"(length({t}) - strpos(reverse({t}), '}}') + 1)"
    rest = f"regexp_replace(regexp_replace({t}, '^[^\\n]*(\\n|$)', ''), '^\\s+|\\s+$', '', 'g')"
    return (f"(CASE WHEN {s} IS NULL OR {s} = '' THEN {s} "
            f"WHEN {st} > 0 AND strpos({t}, '}}') > 0 THEN CASE WHEN {en} >= {st} "
            f"THEN substr({t}, {st}, {en} - {st} + 1) ELSE '' END "
            f"WHEN starts_with({t}, '```') THEN trim(split_part({rest}, '```', 1)) "
            f"ELSE {t} END)")


def answer(s: str) -> str:
    """The carved answer with the first of two equal keys taken out, as the last one counts."""
    return (f"replace(replace({carve(s)}, '\"isCoachingInvoice\": \"dup\", ', ''), "
            f"', \"durationHours\": 99, \"durationHours\"', ', \"durationHours\"')")


def jt(j: str, path: str) -> str:
    return f"json_type({j}, '{path}')"


def opt_str_ok(j: str, path: str) -> str:
    return f"coalesce({jt(j, path)}, 'NULL') IN ('NULL', 'VARCHAR')"


_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE', 'INTEGER')"


def bool_val(j: str, path: str) -> str:
    s = f"lower(json_extract_string({j}, '{path}'))"
    return (f"(CASE {jt(j, path)} WHEN 'BOOLEAN' THEN json_extract_string({j}, '{path}') = 'true' "
            f"WHEN 'VARCHAR' THEN CASE WHEN {s} IN ('1','on','t','true','y','yes') THEN true "
            f"WHEN {s} IN ('0','off','f','false','n','no') THEN false END "
            f"ELSE CASE WHEN {jt(j, path)} IN {_NUM} THEN CASE "
            f"WHEN CAST(json_extract_string({j}, '{path}') AS DOUBLE) = 1 THEN true "
            f"WHEN CAST(json_extract_string({j}, '{path}') AS DOUBLE) = 0 THEN false END END END)")


def float_val(j: str, path: str) -> str:
    return (f"(CASE WHEN {jt(j, path)} IN {_NUM} THEN CAST(json_extract_string({j}, '{path}') AS DOUBLE) "
            f"WHEN {jt(j, path)} = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string({j}, '{path}')) AS DOUBLE) "
            f"WHEN {jt(j, path)} = 'BOOLEAN' THEN CASE WHEN json_extract_string({j}, '{path}') = 'true' "
            f"THEN 1.0 ELSE 0.0 END END)")


_HF = ("supplierName", "invoiceNumber", "invoiceDate", "kvkNumber", "vatNumber")


def header_ok(j: str) -> str:
    fields = " AND ".join(opt_str_ok(j, f"$.invoiceHeader.{f}") for f in _HF)
    return (f"(json_valid({j}) AND {jt(j, '$')} = 'OBJECT' AND {jt(j, '$.invoiceHeader')} = 'OBJECT' "
            f"AND {fields} AND {bool_val(j, '$.isCoachingInvoice')} IS NOT NULL)")


def _marked(shown: str) -> str:
    return f"regexp_matches(lower({shown}), '503|429|overloaded|unavailable')"


def quoted_overload(j: str) -> str:
    """Whether the message of a failed header quotes an overload mark: numbers and lists in
    text fields, and the whole answer (25 characters, 24 from its end) where the flag is absent."""
    def bad(f: str) -> str:
        path = f"$.invoiceHeader.{f}"
        return (f"coalesce({jt(j, path)} IN {_NUM[:-1]}, 'ARRAY') AND "
                + _marked(f"json_extract_string({j}, '{path}')") + ", false)")
    whole = f"replace(replace(replace(replace({j}, '\"', ''''), 'null', 'None'), 'true', 'True'), 'false', 'False')"
    absent = (f"coalesce({jt(j, '$.isCoachingInvoice')} IS NULL AND "
              + _marked(f"left({whole}, 25) || '...' || right({whole}, 24)") + ", false)")
    return " OR ".join([*map(bad, _HF), absent])


def quoted_overload_lines(j: str) -> str:
    """The same for texts given as hours."""
    hours = "json_extract_string(e, '$.durationHours')"
    return (f"coalesce(len(list_filter(json_extract({j}, '$.clientCases[*]'), lambda e: "
            f"json_type(e, '$.durationHours') = 'VARCHAR' AND TRY_CAST({hours} AS DOUBLE) IS NULL AND {_marked(hours)})) > 0, false)")


def _item_ok(e: str) -> str:
    return (f"({jt(e, '$')} = 'OBJECT' AND {jt(e, '$.validatedClientCaseNumber')} = 'VARCHAR' "
            f"AND {opt_str_ok(e, '$.rawClientCaseNumber')} AND {opt_str_ok(e, '$.date')} "
            f"AND (coalesce({jt(e, '$.durationHours')}, 'NULL') = 'NULL' "
            f"OR {float_val(e, '$.durationHours')} IS NOT NULL))")


def lines_ok(j: str) -> str:
    items = f"json_extract({j}, '$.clientCases[*]')"
    names = f"json_extract({j}, '$.clientCasesNoActivity[*]')"
    return (f"(json_valid({j}) AND {jt(j, '$')} = 'OBJECT' "
            f"AND ({jt(j, '$.clientCases')} IS NULL OR ({jt(j, '$.clientCases')} = 'ARRAY' AND "
            f"coalesce(list_bool_and(list_transform({items}, lambda e: coalesce({_item_ok('e')}, false))), true))) "
            f"AND ({jt(j, '$.clientCasesNoActivity')} IS NULL OR ({jt(j, '$.clientCasesNoActivity')} = 'ARRAY' "
            f"AND coalesce(list_bool_and(list_transform({names}, lambda x: coalesce(json_type(x) = 'VARCHAR', false))), true))))")


PHASE2 = MATCHES + "," + FX_RESPONSES.replace(FX_FACTS + ",", "") + f""",
cls00 AS (SELECT *, {answer('response_text')} AS c0 FROM fx_responses WHERE attempt BETWEEN 0 AND 3),
cls0 AS (SELECT *, CASE WHEN json_valid(c0) THEN c0 END AS c FROM cls00),
cls AS (
  SELECT *,
    CASE WHEN error IS NOT NULL THEN
           CASE WHEN contains(lower(error), '503') OR contains(lower(error), 'overloaded')
                  OR contains(lower(error), '429') OR contains(lower(error), 'unavailable')
                THEN 'retry' ELSE 'stop' END
         WHEN response_text IS NULL OR response_text = '' THEN 'stop'
         WHEN agent IN ('header', 'header_recovery') AND coalesce({header_ok('c')}, false) THEN 'ok'
         WHEN agent = 'lines' AND coalesce({lines_ok('c')}, false) THEN 'ok'
         WHEN agent IN ('header', 'header_recovery') AND ({quoted_overload('c')}) THEN 'retry'
         WHEN agent = 'lines' AND {quoted_overload_lines('c')} THEN 'retry'
         ELSE 'stop' END AS cls
  FROM cls0),
dec AS (SELECT doc_id, agent, min(attempt) FILTER (WHERE cls <> 'retry') AS s FROM cls GROUP BY doc_id, agent),
won AS (
  SELECT c.doc_id, c.agent, c.attempt, c.c FROM dec d
  JOIN cls c ON c.doc_id = d.doc_id AND c.agent = d.agent AND c.attempt = d.s
  WHERE c.cls = 'ok'
    AND (SELECT count(*) FROM cls r WHERE r.doc_id = d.doc_id AND r.agent = d.agent
         AND r.cls = 'retry' AND r.attempt < d.s) = d.s),
hdr AS (
  SELECT doc_id, {', '.join(f"json_extract_string(c, '$.invoiceHeader.{f}') AS h_{f}" for f in _HF)},
         {bool_val('c', '$.isCoachingInvoice')} AS coaching
  FROM won WHERE agent = 'header'),
rec AS (
  SELECT doc_id, json_extract_string(c, '$.invoiceHeader.kvkNumber') AS r_kvk,
         json_extract_string(c, '$.invoiceHeader.vatNumber') AS r_vat
  FROM won WHERE agent = 'header_recovery'),
lns AS (
  SELECT doc_id,
    list_transform(coalesce(json_extract(c, '$.clientCases[*]'), []), lambda e: {{
      'v': json_extract_string(e, '$.validatedClientCaseNumber'),
      'r': json_extract_string(e, '$.rawClientCaseNumber'),
      'd': json_extract_string(e, '$.date'),
      'h': {float_val('e', '$.durationHours')}}}) AS cases,
    list_transform(coalesce(json_extract(c, '$.clientCasesNoActivity[*]'), []),
                   lambda x: json_extract_string(x, '$')) AS na
  FROM won WHERE agent = 'lines'),
ocr_src AS (SELECT doc_id, text FROM fx_ocr),{patterns_cte('ocr_src', name='ocrpat')},
work AS (SELECT doc_id, filename, allowed_prompt, allowed_valid FROM p1f
         WHERE is_coaching_invoice AND ready_for_llm AND length(filename) > 0),
f0 AS (
  SELECT w.doc_id, w.filename, w.allowed_prompt, w.allowed_valid,
         {', '.join(f'h.h_{f}' for f in _HF)}, coalesce(h.coaching, false) AS coaching,
         o.text AS ocr_text, op.kvk_numbers[1] AS o_kvk, op.vat_numbers[1] AS o_vat,
         r.r_kvk, r.r_vat, r.doc_id IS NOT NULL AS has_rec,
         l.doc_id IS NOT NULL AS has_lines, l.cases, l.na
  FROM work w LEFT JOIN hdr h ON h.doc_id = w.doc_id LEFT JOIN fx_ocr o ON o.doc_id = w.doc_id
  LEFT JOIN ocrpat_x op ON op.doc_id = w.doc_id LEFT JOIN rec r ON r.doc_id = w.doc_id
  LEFT JOIN lns l ON l.doc_id = w.doc_id),
f1 AS (
  SELECT *, (coalesce(h_kvkNumber, '') = '' OR coalesce(h_vatNumber, '') = '') AS needs_ocr,
         (coalesce(h_kvkNumber, '') = '' OR coalesce(h_vatNumber, '') = '') AND coalesce(ocr_text, '') <> ''
           AS ocr_ok FROM f0),
f2 AS (
  SELECT *,
    CASE WHEN ocr_ok AND coalesce(o_kvk, '') <> '' AND coalesce(h_kvkNumber, '') = '' THEN o_kvk
         ELSE h_kvkNumber END AS kvk1,
    CASE WHEN ocr_ok AND coalesce(o_vat, '') <> '' AND coalesce(h_vatNumber, '') = '' THEN o_vat
         ELSE h_vatNumber END AS vat1 FROM f1),
f3 AS (
  SELECT *, ocr_ok AND (coalesce(kvk1, '') = '' OR coalesce(vat1, '') = '') AND has_rec AS tier2 FROM f2),
f4 AS (
  SELECT *,
    CASE WHEN tier2 AND coalesce(r_kvk, '') <> '' THEN r_kvk ELSE kvk1 END AS kvk2,
    CASE WHEN tier2 AND coalesce(r_vat, '') <> '' THEN r_vat ELSE vat1 END AS vat2,
    CASE WHEN has_lines THEN list_filter(cases, lambda c: c.h IS NOT NULL AND c.h <> 0) ELSE [] END AS active,
    CASE WHEN has_lines THEN list_sort(list_distinct(na || list_transform(
           list_filter(cases, lambda c: (c.h IS NULL OR c.h = 0) AND coalesce(c.v, '') <> ''),
           lambda c: c.v))) ELSE [] END AS na1
  FROM f3),
f5 AS (
  SELECT *,
    list_transform(active, lambda c: CASE
      WHEN list_position(allowed_prompt, c.v) > 0 AND allowed_valid[list_position(allowed_prompt, c.v)] <> c.v
      THEN {{'v': allowed_valid[list_position(allowed_prompt, c.v)], 'r': c.v, 'd': c.d, 'h': c.h}}
      ELSE c END) AS fixed,
    list_sort(list_distinct(list_transform(na1, lambda x: CASE WHEN list_position(allowed_prompt, x) > 0
      THEN allowed_valid[list_position(allowed_prompt, x)] ELSE x END))) AS na2
  FROM f4),
final AS (
  SELECT doc_id, filename, h_supplierName AS supplierName, h_invoiceNumber AS invoiceNumber,
         h_invoiceDate AS invoiceDate, kvk2 AS kvkNumber, vat2 AS vatNumber, coaching AS isCoachingInvoice,
         list_filter(fixed, lambda c: list_contains(allowed_valid, c.v)) AS cases,
         list_sort(list_distinct(list_filter(na2, lambda x: list_contains(allowed_valid, x)))) AS na,
         needs_ocr
  FROM f5)"""

PHASE3 = PHASE2 + "," + FX_TRUTH + """,
ev0 AS (
  SELECT t.filename AS truth_file, replace(t.filename, '.json', '_parsed.json') AS output_file,
         g.doc_id IS NOT NULL AS evaluated,
         CASE WHEN length(g.supplierName) > 0 AND length(t.t_supplierName) > 0
              THEN contains(lower(g.supplierName), lower(t.t_supplierName))
                   OR contains(lower(t.t_supplierName), lower(g.supplierName))
              ELSE g.supplierName IS NOT DISTINCT FROM t.t_supplierName END AS f_supplierName,
         g.invoiceNumber IS NOT DISTINCT FROM t.t_invoiceNumber AS f_invoiceNumber,
         g.invoiceDate IS NOT DISTINCT FROM t.t_invoiceDate AS f_invoiceDate,
         g.kvkNumber IS NOT DISTINCT FROM t.t_kvkNumber AS f_kvkNumber,
         g.vatNumber IS NOT DISTINCT FROM t.t_vatNumber AS f_vatNumber,
         list_sort(list_distinct(list_transform(g.cases, lambda c: c.v))) AS gset,
         list_sort(list_distinct(t.t_codes)) AS tset,
         list_sort(list_distinct(g.na)) AS gna, t.t_na AS tna,
         t.t_supplierName, t.t_invoiceNumber, t.t_invoiceDate, t.t_kvkNumber, t.t_vatNumber,
         g.supplierName AS g_supplierName, g.invoiceNumber AS g_invoiceNumber,
         g.invoiceDate AS g_invoiceDate, g.kvkNumber AS g_kvkNumber, g.vatNumber AS g_vatNumber
  FROM fx_truth t LEFT JOIN final g
    ON replace(g.filename, '.pdf', '_parsed.json') = replace(t.filename, '.json', '_parsed.json')),
ev AS (
  SELECT *, gset = tset AS line_items_ok, gna = tna AS no_activity_ok,
         CAST(f_supplierName AS INTEGER) + CAST(f_invoiceNumber AS INTEGER) + CAST(f_invoiceDate AS INTEGER)
         + CAST(f_kvkNumber AS INTEGER) + CAST(f_vatNumber AS INTEGER) + CAST(gset = tset AS INTEGER)
         + CAST(gna = tna AS INTEGER) AS points,
         list_filter(tset, lambda x: NOT list_contains(gset, x)) AS missing_codes,
         list_filter(gset, lambda x: NOT list_contains(tset, x)) AS unexpected_codes
  FROM ev0)"""
