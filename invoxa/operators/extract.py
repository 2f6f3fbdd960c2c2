"""Pattern extraction over document text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.functions.parsers import extract_patterns, raw_dates

FAMILIES = ("client_cases", "invoice_numbers", "dates_raw", "dates", "amounts", "emails",
            "vat_numbers", "kvk_numbers")


def with_patterns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``patterns`` (struct of the eight lists); the date texts, which two lists share, are
    found in a projection below."""
    return (docs.withColumn("_dates", raw_dates(F.col(text_col)))
            .withColumn("patterns", extract_patterns(F.col(text_col), F.col("_dates"))).drop("_dates"))


def family_long(docs: DataFrame, family: str, key: str = "doc_id") -> DataFrame:
    """Long form (key, pos, value) of one list; ``pos`` is 0-based list order."""
    # Outer generator + null filter: an inner one makes Catalyst add a
    # size(...) > 0 filter that re-runs the extraction expression.
    return (docs.select(key, F.posexplode_outer(F.col("patterns")[family]).alias("pos", "value"))
            .where(F.col("value").isNotNull()))
