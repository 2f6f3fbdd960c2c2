"""Invoice-shaped inputs derived from the driver's TPC-H-style tables.

One invoice per order that has line items: ``doc_id = o_orderkey``. Every
derived table grows with ``orders``/``lineitem``/``part``, so each query built
on them scales with the data. The recipe (documented in FIXTURES.md, part B)
is mirrored in DuckDB SQL by ``invoxa.plans.oracle`` for the correctness gate.

Tables
------
``invoice_pages``  (doc_id, filename, extractor, page_no, page_text)
``registry_codes`` (code, place)                -- the case registry
``model_responses``(doc_id, agent, attempt, response_text, error)
``ocr_texts``      (doc_id, filename, text)
``truth``          (doc_id, filename, invoiceHeader, isCoachingInvoice,
                    clientCases, clientCasesNoActivity)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.functions.patterns import MONTHS_NL
from invoxa.operators.matching import FILE_ORDER
from invoxa.session import apply_defaults
from invoxa.sources.tables import table

NL = "\n"


def _s(c: Column) -> Column:
    return c.cast("string")


def _pad(c: Column, n: int) -> Column:
    """At least ``n`` digits; longer numbers stay whole (``lpad`` alone cuts them)."""
    return F.lpad(_s(c), F.greatest(F.lit(n), F.length(_s(c))), F.lit("0"))


def _grouped(units: Column, sep: str) -> Column:
    """Integer with separators after the thousands and millions; what is above stays whole."""
    return (F.when(units < 1000, _s(units))
            .when(units < 1000000, F.concat(_s((units / 1000).cast("long")), F.lit(sep),
                                            _pad(units % 1000, 3)))
            .otherwise(F.concat(_s((units / 1000000).cast("long")), F.lit(sep),
                                _pad((units / 1000).cast("long") % 1000, 3), F.lit(sep),
                                _pad(units % 1000, 3))))


def eu_amount(x: Column) -> Column:
    cents = F.round(x * 100).cast("long")
    return F.concat(_grouped((cents / 100).cast("long"), "."), F.lit(","), _pad(cents % 100, 2))


def us_amount(x: Column) -> Column:
    cents = F.round(x * 100).cast("long")
    return F.concat(_grouped((cents / 100).cast("long"), ","), F.lit("."), _pad(cents % 100, 2))


def _months() -> Column:
    return F.array(*[F.lit(m) for m in MONTHS_NL])


def raw_code(o: Column, partkey: Column) -> Column:
    """Case code as printed on the invoice, with the document's OCR noise."""
    num = _pad(partkey, 3)
    num = F.when(o % 11 == 2, F.translate(num, "1", "I")).otherwise(num)
    code = F.concat(F.when(o % 7 == 1, "DEM0").otherwise("DEMO"), F.lit("-CASE-"), num)
    return F.when(o % 29 == 6, F.lower(code)).otherwise(code)


def clean_code(partkey: Column) -> Column:
    return F.concat(F.lit("DEMO-CASE-"), _pad(partkey, 3))


def hours_text(q: Column) -> Column:
    """Half hours from the quantity: 0, 0.5, 1, 1.5 written as JSON numbers."""
    h = q.cast("int") % 4
    return F.concat(_s((h / 2).cast("int")), F.when(h % 2 == 1, ".5").otherwise(""))


def _day_first(iso: Column) -> Column:
    """dd-MM-yyyy of a date printed as yyyy-MM-dd."""
    n = F.length(iso)
    return F.concat(F.right(iso, F.lit(2)), F.lit("-"), iso.substr(n - 4, F.lit(2)), F.lit("-"), F.left(iso, n - 6))


def invoice_facts(spark: SparkSession, sf_dir: str, **texts: Column) -> DataFrame:
    """One row per order with line items: order facts + sorted line structs.

    The single shuffle deals the lines out by order key, in the columns as they are
    read: numbers take a fraction of the room of the texts made of them, and of
    half-filled lists. Each order has a handful of lines, so the per-group array is small
    and bounded. ``texts`` are the fields wanted of a line, by ``lineitem``'s columns and the
    line's ``raw`` code and ``ship`` date; they are worked out behind the shuffle, before the
    lines are grouped, in generated code (a lambda over the group is interpreted). They follow
    from the fields before them and so never decide the order. All plans that ask for lines
    and put no condition on the order key below the shuffle share it.

    The lines are sorted by order key there, so that each order is put together from
    neighbouring rows, once, if ``replaceHashWithSortAgg`` is on (``session.apply_defaults``);
    a hash aggregation would write half of its lists out and sort them twice.
    """
    apply_defaults(spark)
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_totalprice")
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey",
               "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    li = li.repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    li = li.withColumns({"raw": raw_code(F.col("l_orderkey"), F.col("l_partkey")),
                         "ship": F.date_format("l_shipdate", "yyyy-MM-dd")})
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
                    *(c.alias(n) for n, c in texts.items()))
    lines = (li.select("l_orderkey", line.alias("line")).groupBy(F.col("l_orderkey").alias("doc_id"))
             .agg(F.sort_array(F.collect_list("line")).alias("lines")))
    return (lines.join(orders, lines.doc_id == orders.o_orderkey, "inner")
            .select("doc_id", F.col("o_custkey").alias("cust"),
                    F.col("o_orderdate").alias("odate"),
                    F.col("o_totalprice").alias("total"), "lines"))


def _header_page() -> Column:
    o, c, d = F.col("doc_id"), F.col("cust"), F.col("odate")
    num = _s(o + 100000)
    number = (F.when(o % 19 == 3, F.concat(F.lit("Betreft: facturen "), num))
              .when(o % 19 == 4, F.lit(None))
              .when(o % 19 == 5, F.concat(F.lit("Factuurnummer:" + NL), num))
              .when(o % 19 == 6, F.concat(F.lit("Ref: INV-"), num))
              .when(o % 19 == 7, F.concat(F.lit("Fact.: "), num, F.lit(".A")))
              .otherwise(F.concat(F.lit("Factuurnummer: "), num)))
    date = (F.when(o % 4 == 0, F.date_format(d, "dd-MM-yyyy"))
            .when(o % 4 == 1, F.date_format(d, "d/M/yy"))
            .when(o % 4 == 2, F.concat_ws(" ", _s(F.dayofmonth(d)),
                                          F.element_at(_months(), F.month(d)), _s(F.year(d))))
            .otherwise(F.date_format(d, "yyyy-MM-dd")))
    k8 = _s(F.lit(10000000) + (o * 7919) % 90000000)
    k7 = _s(F.lit(1000000) + (o * 7919) % 9000000)
    kvk = (F.when(o % 5 == 1, F.concat(F.lit("KvK: "), k8))
           .when(o % 5 == 2, F.concat(F.lit("KvK nummer "), k8))
           .when(o % 5 == 3, F.concat(F.lit("KvK-nr. "), k8))
           .when(o % 5 == 4, F.concat(F.lit("KvK "), k7)))
    v9 = _s(F.lit(100000000) + (o * 104729) % 900000000)
    dotted = F.concat_ws(".", v9.substr(1, 3), v9.substr(4, 3), v9.substr(7, 3))
    vat = (F.when(o % 6 == 1, F.concat(F.lit("BTW nr: NL"), v9, F.lit("B01")))
           .when(o % 6 == 2, F.concat(F.lit("BTW NL "), dotted, F.lit(".B.01")))
           .when(o % 6 == 3, F.concat(F.lit("VAT: DE"), v9))
           .when(o % 6 == 4, F.concat(F.lit("btw "), v9, F.lit("B41")))
           .when(o % 6 == 5, F.concat(F.lit("BTW-id: NL"), v9, F.lit("B02"))))
    email = F.when(o % 3 == 0, F.concat(F.lit("E-mail: billing"), _s(c),
                                        F.lit("@praktijk.example.com")))
    due = F.when(o % 10 == 7, F.concat(F.lit("Vervaldatum: 31-02-"), _s(F.year(d))))
    return F.concat_ws(NL, F.concat(F.lit("Supplier#"), _pad(c % 100, 9)),
                       F.concat(F.lit("Aan: Klant "), _s(c)), number,
                       F.concat(F.lit("Factuurdatum: "), date), due, kvk, vat, email)


def _body_line() -> Column:
    """A line as the body page prints it (columns of ``lineitem``)."""
    o = F.col("l_orderkey")
    code = F.when(o % 13 == 0, F.lit("Advies")).otherwise(F.col("raw"))
    q = F.col("l_quantity").cast("int") % 4
    qty = F.when(o % 53 == 1, F.concat(_s(q * 30), F.lit(" min"))).otherwise(
        F.concat(_s(q), F.lit(" uur")))
    return F.concat_ws(" ", code, _day_first(F.col("ship")), qty, F.concat(F.lit("€ "), eu_amount(F.col("l_extendedprice"))))


def _body_page() -> Column:
    o, t = F.col("doc_id"), F.col("total")
    total = (F.when(o % 8 == 0, F.concat(F.lit("Totaal: € "), eu_amount(t)))
             .when(o % 8 == 1, F.concat(F.lit("EUR "), us_amount(t)))
             .when(o % 8 == 2, F.lit("Bedrag 12,5"))
             .when(o % 8 == 3, F.lit("Total: 99."))
             .when(o % 8 == 5, F.concat(F.lit("$ "), us_amount(t)))
             .when(o % 8 == 7, F.lit("Bedrag: 1,23,456"))
             .otherwise(F.concat(F.lit("Subtotaal: "), eu_amount(t))))
    return F.concat_ws(NL, F.array_join(F.col("lines")["printed"], NL), total)


def filename_of(doc_id: Column) -> Column:
    return F.concat(F.lit("inv_"), _pad(doc_id, 8), F.lit(".pdf"))


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-text table: one row per (doc, extractor, page).

    Extractor variants: o%17=5 -> the primary extractor returns empty pages
    and the secondary has the text; o%51=7 -> both return a short scan stub;
    o%9=4 -> an empty middle page (page numbers still count it).
    """
    f = invoice_facts(spark, sf_dir, printed=_body_line())
    o = F.col("doc_id")
    # The texts are columns of a projection below the generator.
    f = f.select(o, _header_page().alias("header"), _body_page().alias("body"))
    header, body = F.col("header"), F.col("body")

    def page(no, text):
        return F.struct(F.lit(no).alias("page_no"), text.alias("page_text"))

    def pages(extractor, *ps):
        return F.struct(F.lit(extractor).alias("extractor"), F.array(*ps).alias("pages"))

    empty = F.lit("")
    normal = F.when(o % 9 == 4, pages("primary", page(1, header), page(2, empty), page(3, body)))\
        .otherwise(pages("primary", page(1, header), page(2, body)))
    rows = (F.when(o % 51 == 7, F.array(pages("primary", page(1, F.lit("scan"))),
                                        pages("secondary", page(1, F.lit("scan 001")),
                                              page(2, empty))))
            .when(o % 17 == 5, F.array(pages("primary", page(1, empty), page(2, empty)),
                                       pages("secondary", page(1, header), page(2, body))))
            .otherwise(F.array(normal)))
    return (f.select(o, F.explode(rows).alias("x"))
            .select("doc_id", F.col("x.extractor").alias("extractor"),
                    F.explode("x.pages").alias("p"))
            .select("doc_id", filename_of(o).alias("filename"), "extractor",
                    F.col("p.page_no").cast("int").alias("page_no"),
                    F.col("p.page_text").alias("page_text")))


def registry_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case registry from ``part``, in the order of the keys: clean codes of part
    keys not ending in 9; of every third key whose code begins with 1 also its twin
    with I, after it, or before it if the key is even; every 17th code again at the end
    of these. Twins and repeated codes make ambiguous forms."""
    p = table(spark, sf_dir, "part", "p_partkey").where(F.col("p_partkey") % 10 != 9)
    key, num = F.col("p_partkey"), _pad(F.col("p_partkey"), 3)
    twin = F.when(num.startswith("1") & (key % 3 == 1),
                  F.concat(F.lit("DEMO-CASE-I"), num.substr(F.lit(2), F.length(num))))
    rows = F.array(F.struct(F.lit(1).alias("nth"), clean_code(key).alias("code")),
                   F.struct(F.when(key % 2 == 0, 0).otherwise(2).alias("nth"), twin.alias("code")),
                   F.struct(F.lit(3).alias("nth"), F.when(key % 17 == 3, clean_code(key)).alias("code")))
    place = F.struct(F.lit("part").alias("file"), F.floor(key / 65536).alias("block"), (key * 4 + F.col("r.nth")).alias("row"))
    return (p.select(key, F.explode(rows).alias("r")).where(F.col("r.code").isNotNull())
            .select(F.col("r.code").alias("code"), place.alias(FILE_ORDER)))


# --------------------------------------------------------------------------
# Model responses, OCR text and ground truth
# --------------------------------------------------------------------------

def _q(c: Column) -> Column:
    """JSON string literal (values here hold no quote or backslash)."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def _kvk_value(o: Column) -> Column:
    k8 = _s(F.lit(10000000) + (o * 7919) % 90000000)
    k7 = _s(F.lit(1000000) + (o * 7919) % 9000000)
    return F.when(o % 5 == 0, F.lit(None)).when(o % 5 == 4, k7).otherwise(k8)


def _vat_value(o: Column) -> Column:
    v9 = _s(F.lit(100000000) + (o * 104729) % 900000000)
    return (F.when(o % 6 == 3, F.concat(F.lit("DE"), v9))
            .when(o % 6 == 5, F.concat(F.lit("NL"), v9, F.lit("B02")))
            .when(o % 6 == 1, F.concat(F.lit("NL"), v9, F.lit("B01")))
            .when(o % 6 == 2, F.concat(F.lit("NL"), v9, F.lit("B01"))))


def _json_opt(c: Column) -> Column:
    return F.coalesce(_q(c), F.lit("null"))


def _header_json(o: Column, c: Column, d: Column) -> Column:
    kvk = F.when((o % 5 == 0) & (o % 10 == 5), F.lit('""')).otherwise(_json_opt(_kvk_value(o)))
    vat = (F.when(o % 12 == 6, F.lit('""')).when(o % 6 == 4, F.lit('""'))
           .otherwise(_json_opt(_vat_value(o))))
    number = F.when(o % 31 == 2, _s(o + 100000)).otherwise(_q(_s(o + 100000)))
    header = F.concat(
        F.lit('{"supplierName": '), _q(F.concat(F.lit("Supplier#"), _pad(c % 100, 9))),
        F.lit(', "invoiceNumber": '), number,
        F.lit(', "invoiceDate": '), _q(F.date_format(d, "yyyy-MM-dd")),
        F.lit(', "kvkNumber": '), kvk, F.lit(', "vatNumber": '), vat, F.lit("}"))
    header = F.when(o % 31 == 3, F.lit("null")).otherwise(header)
    coaching = F.when(o % 13 == 0, F.lit("false")).otherwise(F.lit("true"))
    tail = F.when(o % 31 == 1, F.lit("}")).otherwise(
        F.concat(F.lit(', "isCoachingInvoice": '), coaching, F.lit("}")))
    # A repeated key, whose last value counts.
    start = F.when(o % 31 == 5, F.lit('{"isCoachingInvoice": "dup", "invoiceHeader": ')).otherwise(F.lit('{"invoiceHeader": '))
    return F.concat(start, header, tail)


def _item_json() -> Column:
    """A line as the answer gives it (columns of ``lineitem``)."""
    o, code, hours = F.col("l_orderkey"), F.col("raw"), hours_text(F.col("l_quantity"))
    hours = F.when(o % 31 == 2, _q(hours)).otherwise(hours)
    key = F.when(o % 31 == 1, F.lit('"caseNumber": ')).otherwise(
        F.lit('"validatedClientCaseNumber": '))
    return F.concat(F.lit("{"), key, _q(code), F.lit(', "rawClientCaseNumber": '), _q(code),
                    F.lit(', "date": '), _q(F.col("ship")),
                    F.when(o % 31 == 5, F.lit(', "durationHours": 99')).otherwise(F.lit("")),
                    F.lit(', "durationHours": '), hours, F.lit("}"))


def _lines_json(o: Column) -> Column:
    items = F.when(o % 13 == 0, F.array().cast("array<string>")).otherwise(F.col("lines")["item"])
    extra = F.when(o % 37 == 4, F.array(F.lit(
        '{"validatedClientCaseNumber": "DEMO-CASE-999", "date": null, "durationHours": 1}'))
    ).otherwise(F.array().cast("array<string>"))
    cases = F.concat(F.lit("["), F.array_join(F.concat(items, extra), ", "), F.lit("]"))
    cases = F.when(o % 31 == 3, F.lit("null")).otherwise(cases)
    first = F.col("lines")[0]["raw"]
    no_act = (F.when(o % 17 == 3, F.concat(F.lit(', "clientCasesNoActivity": ['), _q(first),
                                           F.lit("]")))
              .when(o % 2 == 0, F.lit(', "clientCasesNoActivity": []'))
              .otherwise(F.lit("")))
    return F.concat(F.lit('{"clientCases": '), cases, no_act, F.lit("}"))


def _wrap(o: Column, body: Column) -> Column:
    """Plain, fenced, or with chatter around the JSON object (o%3)."""
    return (F.when(o % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
            .when(o % 3 == 2, F.concat(F.lit("Here is the JSON you asked for:\n"), body,
                                       F.lit("\nLet me know if you need more.")))
            .otherwise(body))


def _tries(x: Column) -> Column:
    return F.when((x >= 1) & (x <= 4), x).otherwise(F.lit(0))


# Answers that fail their schema and whose message quotes an overload code.
QUOTED_LINES = '{"clientCases": [{"validatedClientCaseNumber": "DEMO-CASE-001", "durationHours": "503 h"}]}'
QUOTED_HEADER = '{"invoiceHeader": {"kvkNumber": [429]}, "isCoachingInvoice": true}'


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded model calls: one row per (doc, agent, attempt).

    Per call: k = number of overloaded attempts before the answer (k >= 4:
    never answered); o%23=1 -> the header call fails with a non-overload
    error; o%23=2 -> the lines call returns an empty answer; o%29=6 (lines), 7 (header) ->
    the attempts before the answer fail their schema with a message that quotes a code. Response bodies
    are built once per document, then ``explode`` fans out the attempts.
    """
    f = invoice_facts(spark, sf_dir, raw=F.col("raw"), item=_item_json())
    o, c, d = F.col("doc_id"), F.col("cust"), F.col("odate")
    # Recovery answers exist where the header lacks kvk or vat; o%2=0 also
    # answers the field that was present (the answer overwrites it).
    k8 = _s(F.lit(20000000) + (o * 7919) % 80000000)
    v9 = _s(F.lit(100000000) + (o * 104729) % 900000000)
    rec_kvk = F.when((o % 5 == 0) | (o % 2 == 0), _q(k8)).otherwise(F.lit("null"))
    rec_vat = F.when((o % 6 == 0) | (o % 6 == 4) | (o % 2 == 0),
                     _q(F.concat(F.lit("NL"), v9, F.lit("B07")))).otherwise(F.lit("null"))
    rec_body = F.concat(F.lit('{"invoiceHeader": {"kvkNumber": '), rec_kvk,
                        F.lit(', "vatNumber": '), rec_vat, F.lit('}, "isCoachingInvoice": true}'))
    needs = (o % 5 == 0) | (o % 6 == 0) | (o % 6 == 4) | (o % 31 == 3)

    def call(agent, body, k, other_error, empty):
        return F.struct(F.lit(agent).alias("agent"), body.alias("body"),
                        F.when(other_error | empty, F.lit(0)).otherwise(k).alias("k"),
                        other_error.alias("other_error"), empty.alias("empty"))

    # Bodies are columns of a projection below the generator.
    bodies = f.select(o, _wrap(o, _header_json(o, c, d)).alias("header"), _wrap(o, _lines_json(o)).alias("items"),
                      F.when(needs, rec_body).alias("recovery"))
    calls = F.array(
        call("header", F.col("header"), _tries(o % 10), o % 23 == 1, F.lit(False)),
        call("lines", F.col("items"), _tries((o / 10).cast("long") % 10), F.lit(False),
             o % 23 == 2),
        F.when(needs, call("header_recovery", F.col("recovery"), F.lit(0), F.lit(False), F.lit(False))))
    x = (bodies.select(o, F.explode(calls).alias("c")).where(F.col("c").isNotNull())
         .select("doc_id", "c.*")
         .select("*", F.explode(F.sequence(F.lit(0), F.least(F.col("k"), F.lit(3)))).alias("attempt")))
    a, k = F.col("attempt"), F.col("k")
    overload = F.when(o % 2 == 0, F.lit("503 UNAVAILABLE: The model is overloaded."))\
        .otherwise(F.lit("429 RESOURCE_EXHAUSTED: quota exceeded"))
    quoted = (F.when((F.col("agent") == "lines") & (o % 29 == 6), F.lit(QUOTED_LINES))
              .when((F.col("agent") == "header") & (o % 29 == 7), F.lit(QUOTED_HEADER)))
    text = (F.when(a < k, quoted).when(F.col("other_error"), F.lit(None))
            .when(F.col("empty"), F.lit("")).otherwise(F.col("body")))
    error = (F.when((a < k) & quoted.isNull(), overload)
             .when(F.col("other_error"), F.lit("400 INVALID_ARGUMENT: bad request")))
    return x.select("doc_id", "agent", a.cast("int").alias("attempt"),
                    text.cast("string").alias("response_text"), error.cast("string").alias("error"))


def ocr_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR output for documents whose header lacks kvk or vat.

    o%3=0: kvk and vat lines; 1: kvk only; 2: empty text; o%7=3: no row.
    """
    f = invoice_facts(spark, sf_dir)
    o = F.col("doc_id")
    k8 = _s(F.lit(30000000) + (o * 7919) % 70000000)
    v9 = _s(F.lit(100000000) + (o * 104729) % 900000000)
    text = (F.when(o % 3 == 0, F.concat(F.lit("KvK: "), k8, F.lit("\nBTW nr: NL"), v9,
                                         F.lit("B03")))
            .when(o % 3 == 1, F.concat(F.lit("Kamer van Koophandel\nKvK: "), k8))
            .otherwise(F.lit("")))
    needs = (o % 5 == 0) | (o % 6 == 0) | (o % 6 == 4) | (o % 31 == 3)
    return (f.where(needs & (o % 7 != 3))
            .select("doc_id", filename_of(o).alias("filename"), text.alias("text")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth per coaching invoice (orders whose lines carry codes).

    o%41=1 supplier with a suffix (containment scores), o%41=2 first billable
    case missing, o%41=3 an extra no-activity code; o%19=4 has no number.
    """
    idle = F.col("l_quantity").cast("int") % 4 == 0
    case = F.struct(clean_code(F.col("l_partkey")).alias("validatedClientCaseNumber"),
                    F.col("raw").alias("rawClientCaseNumber"), F.col("ship").alias("date"),
                    hours_text(F.col("l_quantity")).cast("double").alias("durationHours"))
    f = invoice_facts(spark, sf_dir, idle=idle, case=case)
    o, c, d = F.col("doc_id"), F.col("cust"), F.col("odate")
    supplier = F.concat(F.lit("Supplier#"), _pad(c % 100, 9))
    supplier = F.when(o % 41 == 1, F.concat(supplier, F.lit(" B.V."))).otherwise(supplier)
    vat = F.when((o % 6 == 0) | (o % 6 == 4), F.lit(None)).otherwise(_vat_value(o))
    header = F.struct(supplier.alias("supplierName"),
                      F.when(o % 19 == 4, F.lit(None)).otherwise(_s(o + 100000))
                      .cast("string").alias("invoiceNumber"),
                      F.date_format(d, "yyyy-MM-dd").alias("invoiceDate"),
                      _kvk_value(o).cast("string").alias("kvkNumber"),
                      vat.cast("string").alias("vatNumber"))
    cases = F.filter("lines", lambda s: ~s["idle"])["case"]
    cases = F.when(o % 41 == 2, F.slice(cases, F.lit(2), F.size(cases))).otherwise(cases)
    no_act = F.filter("lines", lambda s: s["idle"])["case"]["validatedClientCaseNumber"]
    no_act = F.when(o % 41 == 3, F.concat(no_act, F.array(F.lit("DEMO-CASE-998")))).otherwise(no_act)
    rows = f.select("doc_id", F.concat(F.lit("inv_"), _pad(o, 8), F.lit(".json")).alias("filename"),
                    header.alias("invoiceHeader"), F.lit(True).alias("isCoachingInvoice"),
                    cases.alias("clientCases"),
                    F.sort_array(F.array_distinct(no_act)).alias("clientCasesNoActivity"))
    # A condition on the key would go below the shuffle of the lines, which could then not be
    # shared with pages and answers; one on an outer generator's rows stays above.
    kept = rows.select(F.explode_outer(F.when(o % 13 != 0, F.array(F.struct(*rows.columns)))).alias("t"))
    return kept.where(F.col("t").isNotNull()).select("t.*")
