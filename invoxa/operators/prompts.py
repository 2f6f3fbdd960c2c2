"""Prompt texts as column projections.

The model call itself is outside Spark; these columns are what a batch
inference step would consume. Wording is this library's own; the data slots
follow the original rules: hints print as ``None`` when absent, the allowed
list is one code per line (or a fixed sentence when empty), and the
recovery prompt lists only the missing fields and embeds the values that
exist.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: text used when a document has no allowed codes.
NO_ALLOWED = "(No allowed cases provided)"


def _py(c: Column) -> Column:
    """Python f-string rendering of an optional value (None -> 'None')."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def header_prompt(raw_text: Column, kvk: Column, vat: Column, date: Column, number: Column) -> Column:
    return F.concat(
        F.lit("Extract the invoice header as JSON.\nHINTS:\n- KVK: "), _py(kvk),
        F.lit("\n- VAT: "), _py(vat), F.lit("\n- Date: "), _py(date),
        F.lit("\n- Invoice number: "), _py(number), F.lit("\nTEXT:\n"),
        F.coalesce(raw_text, F.lit("")))


def line_prompt(raw_text: Column, allowed: Column) -> Column:
    listed = F.when(F.coalesce(F.size(allowed), F.lit(0)) > 0, F.array_join(allowed, "\n")) \
        .otherwise(F.lit(NO_ALLOWED))
    return F.concat(F.lit("Extract the billable line items as JSON.\nALLOWED CASES:\n"), listed,
                    F.lit("\nTEXT:\n"), F.coalesce(raw_text, F.lit("")))


def recovery_prompt(ocr_text: Column, supplier: Column, number: Column, date: Column,
                    missing_kvk: Column, missing_vat: Column, coaching: Column) -> Column:
    return F.concat(
        F.lit("Recover the missing header fields from the OCR text.\nMISSING:\n"),
        F.when(missing_kvk, F.lit("- KvK Number\n")).otherwise(F.lit("")),
        F.when(missing_vat, F.lit("- VAT Number\n")).otherwise(F.lit("")),
        F.lit("KNOWN: supplierName="), _py(supplier), F.lit(", invoiceNumber="), _py(number),
        F.lit(", invoiceDate="), _py(date), F.lit(", isCoachingInvoice="),
        F.lower(coaching.cast("string")), F.lit("\nOCR TEXT:\n"), F.coalesce(ocr_text, F.lit("")))
