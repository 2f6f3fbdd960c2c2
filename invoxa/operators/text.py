"""Page text assembly and extractor fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.functions.patterns import PY_WHITESPACE

# FIXED VALUES: extraction method names and the failure message.
METHOD_PDF_TEXT = "pdf_text_extraction"
METHOD_FAILED = "extraction_failed"
ERROR_NO_TEXT = "Failed to extract text"
MIN_USABLE_CHARS = 50

_INK = "[^" + "".join(f"\\u{ord(ch):04x}" for ch in PY_WHITESPACE) + "]"
# Between the first and the last character that is no white space; trimming a text to count
# what is left takes several times as long.
_USABLE = f"(?s){_INK}.{{{MIN_USABLE_CHARS - 1},}}{_INK}"


def _headed(page_no: Column, text: Column) -> Column:
    return F.concat(F.lit("\n--- Page "), page_no.cast("string"), F.lit(" ---\n"), text)


def page_part(page_no: Column, text: Column) -> Column:
    """What one page with text adds to its document's text."""
    return F.concat(_headed(page_no, text), F.lit("\n"))


def page_marker_text(pages: Column) -> Column:
    """Concatenate non-empty pages in page order as "\\n--- Page n ---\\n{text}\\n".

    ``pages``: array<struct<page_no:int, page_text:string>> of one extractor.
    Empty pages are skipped but keep their number.
    """
    wanted = F.filter(F.sort_array(pages), lambda p: F.length(p["page_text"]) > 0)
    return F.array_join(F.transform(wanted, lambda p: page_part(p["page_no"], p["page_text"])), "")


def text_ok(text: Column) -> Column:
    """Usable text: more than 50 characters once surrounding whitespace goes."""
    return F.coalesce(text.rlike(_USABLE), F.lit(False))


def assemble_text(pages: DataFrame) -> DataFrame:
    """(doc_id, extractor, text, text_ok) -- one row per document and extractor."""
    g = (pages.groupBy("doc_id", "extractor")
         .agg(F.collect_list(F.struct("page_no", "page_text")).alias("pages")))
    return g.select("doc_id", "extractor", page_marker_text(F.col("pages")).alias("text"))\
        .withColumn("text_ok", text_ok(F.col("text")))


def document_text(pages: DataFrame) -> DataFrame:
    """One row per document: primary text if usable, else the secondary's.

    A single group-by on ``doc_id`` (the only shuffle of phase 1) collects
    both extractors' pages; choosing between them is row-local, and the secondary's
    text is put together only where it is asked for. The mark is put before a page's text
    in generated code, before the pages are gathered; a lambda over them is interpreted.
    Columns: doc_id, filename, text, extraction_method, error_message, text_length.
    """
    page = F.struct("extractor", "page_no", F.when(F.length("page_text") > 0, _headed(F.col("page_no"), F.col("page_text"))).alias("part"))
    g = (pages.select("doc_id", "filename", page.alias("page")).groupBy("doc_id")
         .agg(F.min("filename").alias("filename"), F.sort_array(F.collect_list("page")).alias("pages")))

    def of(extractor: str) -> Column:
        # Each page ends with a line break.
        parts = F.filter("pages", lambda p: (p["extractor"] == extractor) & p["part"].isNotNull())["part"]
        return F.array_join(F.concat(parts, F.array(F.lit(""))), "\n")

    ok1, ok = F.col("ok1"), F.col("ok1") | text_ok(F.col("text"))
    staged = (g.withColumn("t1", of("primary")).withColumn("ok1", text_ok(F.col("t1")))
              .withColumn("text", F.when(ok1, F.col("t1")).otherwise(of("secondary"))))
    return staged.select(
        "doc_id", "filename", "text",
        F.when(ok, F.lit(METHOD_PDF_TEXT)).otherwise(F.lit(METHOD_FAILED)).alias("extraction_method"),
        F.when(ok, F.lit(None)).otherwise(F.lit(ERROR_NO_TEXT)).cast("string").alias("error_message"),
    ).withColumn("text_length", F.length("text"))
