"""Structured Streaming entry points.

The reference processes a directory listed once; every phase-1 operator is a
stateless column expression, so the same extraction runs on a file stream.
No watermark or state is involved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.functions.parsers import extract_patterns

DOCUMENT_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, directory: str, glob: str = "documents*.parquet",
                    schema: str = DOCUMENT_SCHEMA) -> DataFrame:
    """Streaming scan of document parquet files arriving in ``directory``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", 64).parquet(directory))


def extract_stream(docs: DataFrame) -> DataFrame:
    """Per-document pattern hits (stateless; works on batch or stream)."""
    p = extract_patterns(F.col("text"))
    return docs.select("doc_id", p.alias("patterns")).select(
        "doc_id", F.col("patterns.emails").alias("emails"),
        F.col("patterns.kvk_numbers").alias("kvk_numbers"),
        F.col("patterns.vat_numbers").alias("vat_numbers"),
        F.col("patterns.invoice_numbers").alias("invoice_numbers"),
        F.col("patterns.client_cases").alias("client_cases"))
