"""Extraction page by page, for documents too large to stand in one row.

``document_text`` puts a document's pages into one row, and the patterns run on that row. Here
they run on the pages, so the pages of one document are spread over many tasks, and the lists
come out the same, as rows.

A hit can begin on one page and end behind the next page's marker line (``ref:`` at the foot
of a page takes the marker as its value, ``Factuurnummer:`` takes digits that open the next
page). What follows such a label is white space, colons, hashes and hyphens up to the marker,
whose word ``Page`` no pattern can cross but by one whole line; after that line only white
space and digits can be taken. So each page is searched together with the marker line and the
leading white space and digits of the next page that has text. No pattern can begin in that
opening, so no hit is found twice, and none needs more of the next page.

Page order is kept by blocks of page numbers: neighbours, positions and totals are worked out
inside a block and, over one row a block, between the blocks of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoxa.functions.parsers import normalize_date, normalize_vat, parse_amount
from invoxa.functions.patterns import PATTERN_FAMILIES, java_regex, strip_ws
from invoxa.operators.text import (ERROR_NO_TEXT, METHOD_FAILED, METHOD_PDF_TEXT, MIN_USABLE_CHARS,
                                   page_part)

#: Pages numbered alike up to this divisor share a block.
PAGES_A_BLOCK = 256

_KEYS = ("doc_id", "extractor", "block")

#: How a raw hit becomes a value of its list, and from which patterns.
_VALUES = {"dates_raw": ("dates", lambda x: x), "dates": ("dates", normalize_date),
           "amounts": ("amounts", parse_amount), "vat_numbers": ("vat_numbers", lambda x: normalize_vat(x)["value"]),
           **{f: (f, lambda x: x) for f in ("client_cases", "invoice_numbers", "emails", "kvk_numbers")}}


def _opening(part: Column) -> Column:
    """Marker line of a page's part, and the white space and digits that follow."""
    return F.regexp_extract(part, r"^\n[^\n]*\n(?U:\s*)[0-9]*", 0)


def _rows(pages: DataFrame, pages_a_block: int) -> DataFrame:
    """Every page with text: its place in its block and what opens the page after it there."""
    order = Window.partitionBy(*_KEYS).orderBy("page_no", "page_text")
    return (pages.where((F.length("page_text") > 0) & F.col("page_no").isNotNull())
            .select("doc_id", "extractor", F.floor(F.col("page_no") / pages_a_block).alias("block"), "page_no", "page_text",
                    page_part(F.col("page_no"), F.col("page_text")).alias("part"))
            .select(*_KEYS, F.row_number().over(order).alias("page"), "part",
                    F.lead(_opening(F.col("part"))).over(order).alias("opening")))


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per document, extractor and block: what opens the next block, and what decides
    which extractor's text is usable."""
    # Stripped text begins with the first marker and never ends before the last one.
    blank = F.length("part") - F.length(strip_ws(F.concat(F.lit("-"), F.col("part")))) + 1
    blocks = rows.groupBy(*_KEYS).agg(
        F.sum(F.length("part")).alias("chars"), F.max(F.when(F.col("page") == 1, _opening(F.col("part")))).alias("opens"),
        F.max(F.when(F.col("opening").isNull(), blank)).alias("blank"))
    whole = Window.partitionBy("doc_id", "extractor").orderBy("block")
    all_of = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("*", F.lead("opens").over(whole).alias("next_opening"),
                           (F.sum("chars").over(all_of) - 1 - F.last("blank").over(all_of) > MIN_USABLE_CHARS).alias("ok"))
    first_ok = F.max(F.col("ok") & (F.col("extractor") == "primary")).over(Window.partitionBy("doc_id"))
    wanted = F.when(F.col("first_ok"), "primary").otherwise("secondary")
    return blocks.withColumn("first_ok", first_ok).where(F.col("extractor") == wanted)


def document_parts(pages: DataFrame, pages_a_block: int = PAGES_A_BLOCK) -> DataFrame:
    """The parts of each document's chosen text: doc_id, block, page (place in its block), part
    and searched (the part with the opening of the next). ``pages`` as for ``document_text``;
    a page without text or number has no part."""
    rows = _rows(pages, pages_a_block)
    return (rows.join(_blocks(rows).select(*_KEYS, "next_opening"), list(_KEYS))
            .select("doc_id", "block", "page", "part",
                    F.concat("part", F.coalesce("opening", "next_opening", F.lit(""))).alias("searched")))


def document_state(pages: DataFrame, pages_a_block: int = PAGES_A_BLOCK) -> DataFrame:
    """doc_id, filename, extraction_method, error_message and text_length of each document, as
    ``document_text`` gives them, without putting its text into one row."""
    chosen = _blocks(_rows(pages, pages_a_block)).groupBy("doc_id").agg(F.max("ok").alias("ok"), F.sum("chars").alias("chars"))
    ok = F.coalesce("ok", F.lit(False))
    return (pages.groupBy("doc_id").agg(F.min("filename").alias("filename")).join(chosen, "doc_id", "left")
            .select("doc_id", "filename", F.when(ok, METHOD_PDF_TEXT).otherwise(METHOD_FAILED).alias("extraction_method"),
                    F.when(~ok, ERROR_NO_TEXT).alias("error_message"),
                    F.coalesce("chars", F.lit(0)).cast("int").alias("text_length")))


def family_hits(parts: DataFrame, family: str) -> DataFrame:
    """doc_id, pattern, block, page, hit (place on its page) and raw: every hit of a pattern
    family in the parts of ``document_parts``."""
    def found(number: int, pattern: str, group: int) -> Column:
        raw = F.regexp_extract_all("searched", F.lit(java_regex(pattern)), F.lit(group))
        return F.transform(raw, lambda x, i: F.struct(F.lit(number).alias("pattern"), i.alias("hit"), x.alias("raw")))

    hits = [found(k, p, g) for k, (p, g) in enumerate(PATTERN_FAMILIES[family])]
    return (parts.select("doc_id", "block", "page", F.explode_outer(F.concat(*hits)).alias("h"))
            .where(F.col("h").isNotNull()).select("doc_id", "block", "page", "h.*"))


def family_rows(pages: DataFrame, family: str, pages_a_block: int = PAGES_A_BLOCK) -> DataFrame:
    """doc_id, pos, value: the list ``family`` of each document, one row an element, as
    ``family_long`` gives it. Equal values of a document are combined before the shuffle, and
    positions are counted by pattern and block, so no task holds a whole document."""
    patterns, value_of = _VALUES[family]
    hits = family_hits(document_parts(pages, pages_a_block), patterns).withColumn("value", value_of(F.col("raw")))
    if family not in ("dates", "amounts", "vat_numbers"):
        hits = hits.where(F.col("value") != "")
    first = (hits.where(F.col("value").isNotNull()).groupBy("doc_id", "value")
             .agg(F.min(F.struct("pattern", "block", "page", "hit")).alias("at"))
             .select("doc_id", "value", "at.*"))
    keys = ["doc_id", "pattern", "block"]
    before = Window.partitionBy("doc_id").orderBy("pattern", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = first.groupBy(*keys).agg(F.count("*").alias("n"))
    offsets = sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("page", "hit"))
    return (first.withColumn("k", inside).join(offsets, keys)
            .select("doc_id", (F.col("offset") + F.col("k") - 1).cast("int").alias("pos"), "value"))
