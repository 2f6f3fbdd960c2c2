"""Literal cases for the regex families and parsers (hand-traced rules)."""

from pyspark.sql import functions as F

from conftest import one
from invoxa.functions.codes import canonical_code, contamination
from invoxa.functions.jsonish import carve_json
from invoxa.functions.parsers import (extract_patterns, header_fields, normalize_date,
                                      parse_amount)

X = F.col("x")


def pats(spark, text):
    return one(spark, extract_patterns(X), text).asDict()


def test_kvk_optional_word_eats_a_digit(spark):
    assert pats(spark, "KvK 84726180")["kvk_numbers"] == ["4726180", "84726180"]
    assert pats(spark, "KvK: 84726180")["kvk_numbers"] == ["84726180"]
    assert pats(spark, "KvK 5333777")["kvk_numbers"] == ["5333777"]
    assert pats(spark, "KvK-nr. 12345678")["kvk_numbers"] == ["12345678"]


def test_vat_forms(spark):
    assert pats(spark, "btw 001652526B41")["vat_numbers"] == []
    assert pats(spark, "BTW NL 123.456.789.B.01")["vat_numbers"] == ["NL123456789B01"]
    assert pats(spark, "VAT: DE123456789")["vat_numbers"] == ["DE123456789"]
    assert pats(spark, "BTW nr: NL123456789B01")["vat_numbers"] == ["NL123456789B01"]


def test_amount_parsing(spark):
    vals = {"12,50.": 1250.0, "12,5": 125.0, "1.234": 1.234, "1,23,456": None,
            "1.234,56": 1234.56, "1,234.56": 1234.56, "12,50": 12.5, "99.": 99.0, ".": None}
    for raw, want in vals.items():
        assert one(spark, parse_amount(X), raw) == want, raw


def test_amount_family_and_no_word_boundary(spark):
    p = pats(spark, "Subtotaal: 100,00\n€ 12,50\nEUR 1,234.56\n$ 5")
    assert p["amounts"] == [12.5, 1234.56, 5.0, 100.0]


def test_dates(spark):
    cases = {"1-2-75": "1975-02-01", "1-2-68": "2068-02-01", "31-02-2024": None,
             "3 mei 2024": "2024-05-03", "1-2/2024": None, "2024/2/29": "2024-02-29",
             "12-12-2023": "2023-12-12", "3 foo 2024": None, "1-2-202": None}
    for raw, want in cases.items():
        assert one(spark, normalize_date(X), raw) == want, raw


def test_dates_ordered_by_pattern(spark):
    p = pats(spark, "2024-01-05 and later 06-01-2024")
    assert p["dates_raw"] == ["06-01-2024", "2024-01-05"]
    assert p["dates"] == ["2024-01-06", "2024-01-05"]


def test_invoice_number_rules(spark):
    assert pats(spark, "Factuurnummer: 2024-001")["invoice_numbers"] == ["2024-001"]
    assert pats(spark, "factuur nr. 55")["invoice_numbers"] == []
    assert pats(spark, "ref. 123")["invoice_numbers"] == ["."]
    assert pats(spark, "Betreft: factuur 123")["invoice_numbers"] == []
    assert pats(spark, "Betreft: facturen 123")["invoice_numbers"] == ["123"]
    assert pats(spark, "Factuurnummer:\n\n  4567")["invoice_numbers"] == ["4567"]


def test_cases_keep_case_and_dedupe(spark):
    p = pats(spark, "demo-case-201 DEMO-CASE-201 DEM0-CASE-201 demo-case-201")
    assert p["client_cases"] == ["demo-case-201", "DEMO-CASE-201", "DEM0-CASE-201"]


def test_unicode_whitespace_and_words(spark):
    p = pats(spark, "Totaal: € 1.234,56 op 3 été 2024")
    assert p["amounts"] == [1234.56]
    assert p["dates_raw"] == ["3 été 2024"]
    assert p["dates"] == []


def test_email_class_admits_pipe(spark):
    assert pats(spark, "mail a.b@x.c|m now")["emails"] == ["a.b@x.c|m"]


def test_empty_text(spark):
    p = pats(spark, "")
    assert all(v == [] for v in p.values())


def test_header_fields_first_hits(spark):
    h = one(spark, header_fields(X), "KvK 84726180\nBTW nr: NL123456789B01\nFactuurnummer: 77")
    assert h.asDict() == {"kvkNumber": "4726180", "vatNumber": "NL123456789B01",
                          "invoiceNumber": "77"}


def test_canonical_and_contamination(spark):
    assert one(spark, canonical_code(X), "demo-case-30i") == "DEM0-CASE-301"
    assert one(spark, canonical_code(X), "ABC") == "ABC"
    assert one(spark, canonical_code(X), " DEMO-CASE-OI1 ") == "DEM0-CASE-011"
    assert one(spark, contamination(X), "DEMO-CASE-201") == "O_only"
    assert one(spark, contamination(X), "DEM0-CASE-I01") == "I_only"
    assert one(spark, contamination(X), "x") == "none"


def test_canonical_idempotent(spark):
    codes = ["demo-case-30i", "DEMO-CASE-I1O", "abc", "DEM0-CASE-999-X", "dEmO-CaSe-0o1"]
    df = spark.createDataFrame([(c,) for c in codes], "x string")
    r = df.select(canonical_code(X).alias("a"), canonical_code(canonical_code(X)).alias("b")).collect()
    assert all(row.a == row.b for row in r)


def test_carve_json(spark):
    assert one(spark, carve_json(X), "x {a} y") == "{a}"
    assert one(spark, carve_json(X), "} then {") == ""
    assert one(spark, carve_json(X), "```json\nnull\n```") == "null"
    assert one(spark, carve_json(X), "") == ""
    assert one(spark, carve_json(X), None) is None


def test_faster_searches_find_the_same(spark):
    """Every pattern with its start, literal and possessive run, against the pattern as it stands in
    the table, on random texts with the letters of other scripts that fold to ASCII ones."""
    import random

    from invoxa.functions.patterns import JAVA_FLAGS, PATTERN_FAMILIES, pattern_matches
    words = ["DEMO-CASE-1", "dem0-caſe-I2", "Factuurnummer:", "factuur nr.", "invoice number", "İnvoice-number",
             "ınvoıce number", "Betreft: facturen", "ref", "éref:", "reference", "Fact.:", "fact. :", "1-2-1999", "3/4/99",
             "12 mei 2001", "2001-02-03", "١-٢-١٩٩٩", "€", "EUR", "$", "total", "Totaal:", "amount", "bedrag",
             "a.b+c@d.example", "x@y@z.nl", "@", "a@b.c", "NL 123.456.789.B.01", "btw", "BTW-id:", "ob-nummer", "vat id", "tax",
             "omzetbelaſtingnummer", "123456789 B 01", "kvk", "KvK nr.", "KvK-nummer", "12345678", "1.234,56", " ", "\n", "\r", "_", "́"]
    rnd = random.Random(5)
    rows = [("".join(rnd.choice(words) + rnd.choice([" ", "", " ", "\n", ": "]) for _ in range(rnd.randint(1, 14))),) for _ in range(1500)]
    texts = spark.createDataFrame(rows, "x string")
    for family, patterns in PATTERN_FAMILIES.items():
        for pattern, group in patterns:
            plain = F.regexp_extract_all(X, F.lit(JAVA_FLAGS + pattern), F.lit(group))
            found = texts.select("x", plain.alias("plain"), pattern_matches(X, pattern, group).alias("fast"))
            assert found.where(F.size("plain") > 0).count() > 0, (family, pattern)
            assert found.where(~F.col("plain").eqNullSafe(F.col("fast"))).take(3) == [], (family, pattern)


def test_day_first_of_a_printed_date(spark):
    from invoxa.sources.fixtures import _day_first
    for iso in ("1995-03-09", "0001-01-31", "+10000-02-03"):
        year, month, day = iso.rsplit("-", 2)
        assert one(spark, _day_first(X), iso) == f"{day}-{month}-{year}"
    assert one(spark, _day_first(X), None) is None
