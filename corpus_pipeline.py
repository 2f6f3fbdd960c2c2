"""Cleaning and packing of a document corpus, stage by stage.

``STAGES`` lists (name, function); each function takes the session, the documents
its predecessor kept, and the input folder. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.llm import langid, packing, pii, simhash, substring
from invoxa.llm.common import written
from invoxa.llm.queries import tokenizer_file

#: No stage but the PII rules can be put in SQL; tests compare with brute force.
ORACLE_SQL = None


def _with_text(found: DataFrame, columns: list[str], text: Column, changed: Column) -> DataFrame:
    """The columns of ``row``, with ``text`` and its length where ``changed``."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    row = F.col("row")
    return found.select(*((F.when(changed, new[c]).otherwise(row[c]) if c in new else row[c]).alias(c) for c in columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects."""
    return langid.drop_rejected(docs, langid.train(langid.training_rows(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, words=3, radius=2)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 13 words that an earlier document holds. A document that
    loses any has its other words joined by one space; no document goes."""
    return _with_text(substring.remove_repeats(docs), docs.columns, F.col("kept"), F.col("n_removed") > 0)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind, such as [EMAIL], in place of each span of personal data."""
    found = pii.find_pii(docs).withColumn("masked", pii.mask(F.col("text"), F.col("spans")))
    return _with_text(found, docs.columns, F.col("masked"), F.size("spans") > 0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), special=True)


STAGES = [("language_id", language), ("simhash", near_duplicates), ("substring", repeats), ("pii", personal_data),
          ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's rows are written to the
    shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
