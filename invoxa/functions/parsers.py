"""Parsers and normalisers for amounts, VAT numbers and dates (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from invoxa.functions.patterns import (MONTHS_NL, VAT_EU_GENERIC, VAT_LABEL_PREFIX,
                                       VAT_NL_CANON, dedupe, family_matches)


def _last_pos(s: Column, ch: str) -> Column:
    """1-based position of the last ``ch`` in ``s`` (0 when absent)."""
    return F.length(s) - F.length(F.substring_index(s, ch, -1))


def parse_amount(raw: Column) -> Column:
    """EU/US amount text -> double, NULL when unparseable.

    Both separators: the later one is the decimal mark. Comma only: if the text
    between the first and second comma has exactly two characters the commas
    are decimal marks, else thousands marks. Dot only: parsed as is.
    """
    s = F.regexp_replace(raw, " ", "")
    has_c = F.locate(",", s) > 0
    has_d = F.locate(".", s) > 0
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    no_commas = F.replace(s, F.lit(","), F.lit(""))
    second = F.element_at(F.split(s, ","), 2)
    clean = (F.when(has_c & has_d,
                    F.when(_last_pos(s, ",") > _last_pos(s, "."), eu).otherwise(no_commas))
             .when(has_c,
                   F.when(F.length(second) == 2, F.replace(s, F.lit(","), F.lit(".")))
                   .otherwise(no_commas))
             .otherwise(s))
    return F.when(F.length(s) > 0, clean.try_cast("double"))


def parse_amounts(raw_arr: Column) -> Column:
    parsed = F.transform(raw_arr, parse_amount)
    return F.array_distinct(F.filter(parsed, lambda x: x.isNotNull()))


def normalize_vat(raw: Column) -> Column:
    """struct(value, kind) with kind 'nl' or 'eu'; NULL when not a VAT number."""
    cleaned = F.regexp_replace(F.upper(raw), F.lit(r"(?U)[\s.\-]"), F.lit(""))
    cleaned = F.regexp_replace(cleaned, F.lit(VAT_LABEL_PREFIX), F.lit(""))
    nl = F.concat(F.lit("NL"), cleaned.substr(3, 9), F.lit("B"), F.right(cleaned, F.lit(2)))
    return (F.when(F.length(raw) == 0, F.lit(None))
            .when(cleaned.rlike(r"(?U)(?i)" + VAT_NL_CANON),
                  F.struct(nl.alias("value"), F.lit("nl").alias("kind")))
            .when(cleaned.rlike(r"(?U)" + VAT_EU_GENERIC),
                  F.struct(cleaned.alias("value"), F.lit("eu").alias("kind"))))


def parse_vats(raw_arr: Column) -> Column:
    vals = F.transform(raw_arr, lambda r: normalize_vat(r)["value"])
    return F.array_distinct(F.filter(vals, lambda x: x.isNotNull()))


def _month_map() -> Column:
    return F.create_map(*[x for i, m in enumerate(MONTHS_NL, 1) for x in (F.lit(m), F.lit(i))])


def _ymd(y: Column, m: Column, d: Column) -> Column:
    date = F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")
    return F.when(y.cast("int") >= 1, F.date_format(date, "yyyy-MM-dd"))


def normalize_date(raw: Column) -> Column:
    """Date text -> ISO 'yyyy-MM-dd' string, NULL when no accepted form parses.

    Accepted, tried in this order: d-m-Y, d/m/Y, d-m-y, d/m/y, Y-m-d, Y/m/d
    (Y exactly four digits, y exactly two with 69..99 -> 19yy, 00..68 -> 20yy,
    day and month one or two digits, one separator kind per date), then
    "d <Dutch month name> Y". The numeric forms are mutually exclusive by
    shape, so the first matching shape decides.
    """
    s = raw
    dmy = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$"
    dmy2 = r"^(\d{1,2})([-/])(\d{1,2})\2(\d{2})$"
    ymd = r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$"
    named = r"(?U)^\s*(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})\s*$"

    def g(p: str, i: int) -> Column:
        return F.regexp_extract(s, p, i)

    yy = g(dmy2, 4).cast("int")
    y_pivot = F.when(yy >= 69, yy + 1900).otherwise(yy + 2000).cast("string")
    month = F.try_element_at(_month_map(), F.lower(g(named, 2)))
    return (F.when(s.rlike(dmy), _ymd(g(dmy, 4), g(dmy, 3), g(dmy, 1)))
            .when(s.rlike(dmy2), _ymd(y_pivot, g(dmy2, 3), g(dmy2, 1)))
            .when(s.rlike(ymd), _ymd(g(ymd, 1), g(ymd, 3), g(ymd, 4)))
            .when(s.rlike(named) & month.isNotNull(),
                  _ymd(g(named, 3), month.cast("string"), g(named, 1))))


def normalize_dates(raw_arr: Column) -> Column:
    iso = F.transform(raw_arr, normalize_date)
    return F.array_distinct(F.filter(iso, lambda x: x.isNotNull()))


def raw_dates(text: Column) -> Column:
    """The date texts as found, each once."""
    return dedupe(family_matches(F.coalesce(text, F.lit("")), "dates"))


def extract_patterns(text: Column, dates_raw: Column | None = None) -> Column:
    """All families as one struct column (the ``patterns_found`` record).

    Empty or NULL text yields empty lists, as the search is skipped then.
    ``dates_raw``: ``raw_dates(text)``, if it is at hand as a column; two lists
    are made of it, and a lambda's input is worked out apart from its other uses.
    """
    t = F.coalesce(text, F.lit(""))
    dates_raw = raw_dates(text) if dates_raw is None else dates_raw
    fields = {
        "client_cases": dedupe(family_matches(t, "client_cases")),
        "invoice_numbers": dedupe(family_matches(t, "invoice_numbers")),
        "dates_raw": dates_raw,
        "dates": normalize_dates(dates_raw),
        "amounts": parse_amounts(family_matches(t, "amounts")),
        "emails": dedupe(family_matches(t, "emails")),
        "vat_numbers": parse_vats(family_matches(t, "vat_numbers")),
        "kvk_numbers": dedupe(family_matches(t, "kvk_numbers")),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def header_fields(text: Column) -> Column:
    """Best guess per header field: first kvk, vat and invoice-number hit."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(
        F.get(dedupe(family_matches(t, "kvk_numbers")), 0).alias("kvkNumber"),
        F.get(parse_vats(family_matches(t, "vat_numbers")), 0).alias("vatNumber"),
        F.get(dedupe(family_matches(t, "invoice_numbers")), 0).alias("invoiceNumber"),
    )
