"""Line-item rules stated for the model, re-aimed as column operators.

These rules exist in the reference only as instructions to the model; here
they are plain DataFrame operators over invoice text and final results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.functions.parsers import normalize_date
from invoxa.functions.patterns import PATTERN_FAMILIES, java_regex

# A billable line: "<case code> <date> <quantity> <unit> ...". The code
# pattern is the client-case family's own pattern.
_CODE = PATTERN_FAMILIES["client_cases"][0][0].replace("(?i)", "")
LINE_PATTERN = (r"(?i)^\s*" + _CODE + r"\s+(\d{1,2}-\d{1,2}-\d{4})\s+(\d+(?:[.,]\d+)?)\s+"
                r"(uur|u|hours?|h|min|minuten|minutes?)\b")
# FIXED VALUES: unit words meaning minutes.
MINUTE_UNITS = ("min", "minuten", "minute", "minutes")


def normalize_hours(value: Column, unit: Column) -> Column:
    """Quantity in hours: minutes / 60 (60 -> 1.0, 30 -> 0.5), hours as is."""
    v = F.regexp_replace(value, ",", ".").try_cast("double")
    return F.when(F.lower(unit).isin(*MINUTE_UNITS), v / 60.0).otherwise(v)


def line_items(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per billable text line: (doc_id, line_no, code, date, hours).

    ``split`` + ``posexplode`` keeps the work per row (no shuffle); lines
    that are not billable line items are dropped.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    pat = java_regex(LINE_PATTERN)
    x = lines.where(F.col("line").rlike(pat))
    return x.select("doc_id", "line_no",
                    F.regexp_extract("line", pat, 1).alias("code"),
                    normalize_date(F.regexp_extract("line", pat, 2)).alias("date"),
                    normalize_hours(F.regexp_extract("line", pat, 3),
                                    F.regexp_extract("line", pat, 4)).alias("hours"))


def hours_by_case_date(cases: DataFrame) -> DataFrame:
    """Sum hours of repeated lines of the same case on the same date (dates
    kept apart). ``cases``: doc_id, code, date, hours."""
    return (cases.groupBy("doc_id", "code", "date")
            .agg(F.sum("hours").alias("hours"), F.count(F.lit(1)).alias("n_lines")))
