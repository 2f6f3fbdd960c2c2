"""Regex pattern families and the Column expressions that apply them.

All extraction runs inside the JVM (``regexp_extract_all`` on java.util.regex);
no Python touches row data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES: the pattern table must equal the extraction rules being
# reproduced, family by family and in this order (hits are appended pattern by
# pattern, so the order is part of the result). Each entry is
# (pattern, capture group); group 0 = whole match.
# ---------------------------------------------------------------------------
PATTERN_FAMILIES: dict[str, list[tuple[str, int]]] = {
    "client_cases": [
        (r"(?i)\b(DEM[O0]-CASE-[A-Z0-9-]+)\b", 1),
    ],
    "invoice_numbers": [
        (r"(?i)\b(?:factuurnummer|factuur ?nr\.?|invoice.?number)\b[:\s]+([A-Z0-9./-]+)", 1),
        (r"(?i)Factuurnummer:\s*\n(?:.*\n)?\s*([0-9]{3,})", 1),
        (r"(?i)\bBetreft:\s*facturen?\s+(\d{3,})", 1),
        (r"(?i)\b(?:ref|reference)\b[:\s#-]*([A-Z0-9./-]+)", 1),
        (r"(?i)\bFact\.:\s*([A-Z0-9._-]+)", 1),
    ],
    "dates": [
        (r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\b", 1),
        (r"\b(\d{1,2}\s+\w+\s+\d{4})\b", 1),
        (r"\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b", 1),
    ],
    "amounts": [
        (r"€\s*([\d.,]+)", 1),
        (r"EUR\s*([\d.,]+)", 1),
        (r"\$\s*([\d.,]+)", 1),
        (r"(?i)(?:total|totaal|amount|bedrag)[:\s]*(?:€|\$|EUR)?\s*([\d.,]+)", 1),
    ],
    "emails": [
        (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", 0),
    ],
    "vat_numbers": [
        (r"(?i)\b(NL\s*(?:\d[.\s]?){9}B\.?\s*\d{2})\b", 1),
        (r"(?i)\b(?:btw|omzetbelastingnummer|ob-nummer|ob nummer)\b.*?(\d{9}\s*B\s*\d{2})", 1),
        (r"(?i)(?:btw(?:-id)?|btw ?nr\.?|vat(?: ?id)?|tax(?: ?id)?)[:\s#-]*([A-Z0-9.\-]+)", 1),
    ],
    "kvk_numbers": [
        (r"(?i)\bkvk(?:[-\s]?nummer|nr\.?)?(?:\s+\w+)?[:\s#-]*([0-9]{7,8})", 1),
        (r"(?i)kvk.*?(\d{8})", 1),
    ],
}

# FIXED VALUES: accepted VAT shapes after cleaning, and the label prefixes that
# are stripped first (longest alternatives first, as written).
VAT_NL_CANON = r"^NL\d{9}B\d{2}$"
VAT_EU_GENERIC = r"^[A-Z]{2}\d{8,12}$"
VAT_LABEL_PREFIX = r"^(BTWID|BTWNR|BTW|VATID|VATNR|VAT|TAXID|TAXNR|TAX)"

# FIXED VALUES: Dutch month names, January..December.
MONTHS_NL = ["januari", "februari", "maart", "april", "mei", "juni",
             "juli", "augustus", "september", "oktober", "november", "december"]

# What speeds the search up and changes no hit. STARTS: the characters a hit of the pattern can
# begin with, case folding included (of other scripts only U+0130 and U+0131 fold to i, U+017F to s
# and U+212A to k); looking for one first is cheaper at each place than a word boundary or a
# choice of words. LITERALS: a text that every hit holds and no case folding touches.
STARTS = {
    PATTERN_FAMILIES["client_cases"][0][0]: "[Dd]",
    PATTERN_FAMILIES["invoice_numbers"][0][0]: "[FfIi\u0130\u0131]",
    PATTERN_FAMILIES["invoice_numbers"][2][0]: "[Bb]",
    PATTERN_FAMILIES["invoice_numbers"][3][0]: "[Rr]",
    PATTERN_FAMILIES["invoice_numbers"][4][0]: "[Ff]",
    PATTERN_FAMILIES["dates"][0][0]: r"\d",
    PATTERN_FAMILIES["dates"][2][0]: r"\d",
    PATTERN_FAMILIES["amounts"][3][0]: "[TtAaBb]",
    PATTERN_FAMILIES["vat_numbers"][0][0]: "[Nn]",
    PATTERN_FAMILIES["vat_numbers"][1][0]: "[BbOo]",
    PATTERN_FAMILIES["vat_numbers"][2][0]: "[BbVvTt]",
    PATTERN_FAMILIES["kvk_numbers"][0][0]: "[Kk\u212a]",
}
LITERALS = {
    PATTERN_FAMILIES["invoice_numbers"][4][0]: ".:",
    PATTERN_FAMILIES["amounts"][0][0]: "€",
    PATTERN_FAMILIES["amounts"][1][0]: "EUR",
    PATTERN_FAMILIES["amounts"][2][0]: "$",
    PATTERN_FAMILIES["emails"][0][0]: "@",
}

# Java regex flags that give Python ``str``-regex semantics: Unicode classes
# for \w \d \s \b and case folding (U), and '\n' as the only line end for '.'
# (d). Without U, "€<NBSP>1.234,56" and accented words are missed.
JAVA_FLAGS = "(?U)(?d)"


def java_regex(pattern: str) -> str:
    start = STARTS.get(pattern)
    # A run of the e-mail class never holds the @ after it, so giving characters back finds none.
    fast = pattern.replace("+-]+@", "+-]++@")
    return JAVA_FLAGS + (f"(?={start})" if start else "") + fast


def pattern_matches(text: Column, pattern: str, group: int) -> Column:
    """All raw hits of one pattern; texts without its literal are not searched."""
    hits = F.regexp_extract_all(text, F.lit(java_regex(pattern)), F.lit(group))
    if pattern not in LITERALS:
        return hits
    return F.when(text.contains(LITERALS[pattern]), hits).otherwise(F.array().cast("array<string>"))


def family_matches(text: Column, family: str) -> Column:
    """All raw hits of one family: pattern by pattern, each in text order."""
    parts = [pattern_matches(text, p, g) for p, g in PATTERN_FAMILIES[family]]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def dedupe(arr: Column) -> Column:
    """Order-preserving distinct of non-blank hits.

    No capture in the table can begin or end with whitespace (every capture
    starts and ends with a digit, letter or punctuation class), so trimming is
    the identity here; dropping blanks and keeping first occurrences is all
    that remains. ``array_remove``/``array_distinct`` stay in generated code.
    """
    return F.array_distinct(F.array_remove(arr, ""))


# Characters Python's str.strip() removes, derived from str.isspace() (all
# are in the Basic Multilingual Plane).
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())


def strip_ws(s: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends.

    ``btrim`` with an explicit character set is a linear scan in generated
    code (an anchored whitespace regex costs several times more on long text).
    """
    return F.btrim(s, F.lit(PY_WHITESPACE))
