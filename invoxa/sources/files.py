"""File sources and sinks of the batch flow.

The batch tool hands data between phases through files: a registry CSV,
raw-text files, a metadata object keyed by file name, a manifest, one JSON
result per invoice and one truth JSON per invoice. These readers and writers
map each onto a DataFrame; all of them are plain ``spark.read``/``df.write``
calls, so they run unchanged on a cluster file system. One file per document is
written by ``document_files``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.functions.jsonish import CASE_TYPE
from invoxa.operators.documents import raw_text_envelope, raw_text_file
from invoxa.operators.matching import FILE_ORDER, context_lists
from invoxa.sources.document_files import write_document_files

TRUTH_SCHEMA = (
    "invoiceHeader struct<supplierName:string,invoiceNumber:string,invoiceDate:string,"
    "kvkNumber:string,vatNumber:string>, isCoachingInvoice boolean, "
    f"clientCases array<{CASE_TYPE}>, clientCasesNoActivity array<string>")

MANIFEST_SCHEMA = (
    "total_invoices long, processing_date string, "
    "invoices array<struct<filename:string,confidence:double,is_coaching_invoice:boolean,"
    "client_case_verdict:string,client_case_reason:string,ready_for_llm:boolean>>")

MATCH = ("struct<matchedCode:string,matchStatus:string,matchConfidence:double,contamination:string,"
         "candidates:array<string>,notes:string>")

METADATA_VALUE = (
    "struct<text_length:int,extraction_method:string,confidence_score:double,kvk:string,"
    "vat:string,invoice_number:string,invoice_date:string,"
    "patterns_found:struct<client_cases:array<string>,invoice_numbers:array<string>,"
    "dates_raw:array<string>,dates:array<string>,amounts:array<double>,emails:array<string>,"
    f"vat_numbers:array<string>,kvk_numbers:array<string>,client_case_matches:map<string,{MATCH}>>,"
    "client_case_summary:struct<verdict:string,reason:string,counts:map<string,long>>,"
    "raw_text_file:string,text_preview:string>")


def _file_name() -> F.Column:
    """Decoded file name ('%20' -> ' '; a literal '+' is kept)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


# ------------------------------------------------------------------ sources
def list_documents(spark: SparkSession, directory: str, glob: str = "*.pdf") -> DataFrame:
    """(filename, path, size) of the input documents by name; file bytes are not read."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
          .select(F.element_at(F.split("path", "/"), -1).alias("filename"), "path",
                  F.col("length").alias("size")))
    return df.orderBy("filename")


def read_registry_csv(spark: SparkSession, path: str) -> DataFrame:
    """Registry CSV with a header row (CRLF line ends are fine); pass the
    result to ``matching.ref_codes``, which picks ``clientCaseNumber`` or
    else the first column, trims and skips blanks. ``FILE_ORDER`` says where a row
    stands: its file, the block of the file that one task reads, and its place
    among what that task reads."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return spark.read.option("header", True).option("inferSchema", False).csv(path).select("*", place.alias(FILE_ORDER))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per manifest invoice entry of one-object files (large batches:
    ``read_manifest_lines``)."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
    return m.select(F.explode("invoices").alias("i")).select("i.*")


def _pieces(spark: SparkSession, path: str, end: str) -> DataFrame:
    """(value) of text files, cut behind each ``end``, which is left out. Spark gives
    the blocks of a large file to several tasks."""
    return spark.read.option("lineSep", end).text(path)


def _unless(fault: Column, value: Column, path: str, indent: int) -> Column:
    message = f"{path}: not a file of one object, indented by {indent}"
    return F.when(fault, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def read_manifest_parts(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """What ``read_manifest`` gives, of files laid out by ``indent`` (each entry of the
    list begins and ends with a line that holds only its brace), read by many tasks.

    A line break within a JSON string is always escaped, so the line that ends an
    entry is found wherever a block starts. A file in another layout raises an error.
    """
    pad = "\n" + " " * (2 * indent)
    value = F.col("value")
    begins = F.size(F.split(value, rf"\n {{{2 * indent}}}\{{")) - 1
    braces = F.length(value) - F.length(F.translate(value, "{", ""))
    fault = (begins > 1) | ((begins == 0) & (braces > 1))
    entry = F.concat(value.substr(F.instr(value, pad + "{"), F.length(value)), F.lit(pad + "}"))
    fault = fault | ((begins == 1) & F.json_object_keys(entry).isNull())
    kind = MANIFEST_SCHEMA.split("array<", 1)[1].removesuffix(">")
    checked = _unless(fault, F.when(begins == 1, entry), path, indent)
    return (_pieces(spark, path, pad + "}").select(checked.alias("entry")).where(F.col("entry").isNotNull())
            .select(F.from_json("entry", kind).alias("i")).select("i.*"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Metadata object keyed by file name -> one row per file name. The object is one
    row, as that file format has it; large batches use ``read_metadata_lines``."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", f"map<string,{METADATA_VALUE}>").alias("m"))
    return parsed.select(F.explode("m").alias("filename", "meta")).select("filename", "meta.*")


def read_metadata_parts(spark: SparkSession, path: str, indent: int = 2) -> DataFrame:
    """What ``read_metadata`` gives, of files laid out by ``indent``, read by many tasks:
    the text between the ends of two entries is an object of its own. A file in another
    layout is one piece or raises an error."""
    end = "\n" + " " * indent + "}"
    value = F.col("value")
    inner = F.regexp_replace(value, r"\A\s*[{,]", "")
    last = value.rlike(r"(\n|\A\s*\{\s*)\}\s*\z")
    text = F.concat(F.lit("{"), inner, F.when(last, F.lit("")).otherwise(F.lit(end + "}")))
    nothing = F.trim(F.translate(inner, "\r\n\t", "   ")).isin("", "}")
    found = F.from_json("text", f"map<string,{METADATA_VALUE}>")
    pieces = (_pieces(spark, path, end).where(~nothing).select(text.alias("text"))
              .select(_unless(F.json_object_keys("text").isNull(), F.col("text"), path, indent).alias("text")))
    return pieces.select(F.explode(found).alias("filename", "meta")).select("filename", "meta.*")


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_manifest`` wrote: one JSON line per invoice, split over tasks."""
    entry = MANIFEST_SCHEMA.split("array<struct<", 1)[1].removesuffix(">>")
    return spark.read.schema(entry.replace(":", " ")).json(path)


def read_metadata_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_metadata`` wrote: one JSON line per document."""
    return spark.read.schema(f"filename string, meta {METADATA_VALUE}").json(path).select("filename", "meta.*")


def read_raw_texts(spark: SparkSession, directory: str, suffix: str = "_raw.txt") -> DataFrame:
    """(filename, raw_text): whole text files; ``X_raw.txt`` -> ``X.pdf``."""
    df = spark.read.option("pathGlobFilter", f"*{suffix}").text(directory, wholetext=True)
    name = _file_name()
    stem = F.expr(f"left(_metadata.file_name, length(_metadata.file_name) - {len(suffix)})")
    stem = F.url_decode(F.replace(stem, F.lit("+"), F.lit("%2B")))
    return df.select(F.concat(stem, F.lit(".pdf")).alias("filename"),
                     F.col("value").alias("raw_text"), name.alias("source_file"))


def read_raw_text_table(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_raw_texts`` wrote: (filename, raw_text), envelope included."""
    name = F.regexp_replace("raw_text_file", r"^raw_texts/(.*)_raw\.txt$", "$1.pdf")
    return spark.read.parquet(path).select(name.alias("filename"), F.col("content").alias("raw_text"))


def read_json_results(spark: SparkSession, directory: str, glob: str = "*.json") -> DataFrame:
    """Invoice result / truth JSON files with file name: ONE object per file. Files
    of many lines, as ``write_results`` writes, are for ``read_result_lines``."""
    df = (spark.read.schema(TRUTH_SCHEMA).option("multiLine", True)
          .option("pathGlobFilter", glob).json(directory))
    return df.select(_file_name().alias("filename"), "*")


def read_result_lines(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_results`` wrote: many results to a file, one per line; the name
    comes from each line's ``output_file`` (``X_parsed.json`` -> ``X.pdf``)."""
    df = spark.read.schema(f"output_file string, {TRUTH_SCHEMA}").json(path)
    name = F.regexp_replace("output_file", r"_parsed\.json$", ".pdf")
    return df.select(name.alias("filename"), "*").drop("output_file")


def work_list_from_files(manifest: DataFrame, metadata: DataFrame, raw_texts: DataFrame) -> DataFrame:
    """Ready coaching invoices that have metadata and a raw-text file (inner joins on
    file name: unmatched entries are dropped), with the context of the prompts:
    ``allowed_prompt``, ``allowed_valid`` and ``correction_map`` from the saved matches."""
    m = manifest.where(F.col("is_coaching_invoice") & F.col("ready_for_llm")
                       & F.coalesce(F.length("filename") > 0, F.lit(False)))
    # The context comes before the join, so the match records are not shuffled where nobody reads them.
    prompt, valid = context_lists(F.col("patterns_found.client_case_matches"))
    found = metadata.withColumns({"allowed_prompt": prompt, "allowed_valid": valid})
    w = m.join(found, "filename", "inner").join(raw_texts, "filename", "inner")
    return w.withColumn("correction_map", F.map_from_arrays("allowed_prompt", "allowed_valid"))


# ------------------------------------------------------------------ sinks
def write_raw_texts(docs: DataFrame, path: str, extracted_at: str) -> None:
    """Raw-text envelope per document as a (raw_text_file, content) table; read it
    with ``read_raw_text_table``."""
    (docs.select(raw_text_file(F.col("filename")).alias("raw_text_file"),
                 raw_text_envelope(F.col("filename"), F.col("text"), F.lit(extracted_at))
                 .alias("content"))
     .write.mode("overwrite").option("compression", "zstd").parquet(path))


def write_raw_text_files(docs: DataFrame, folder: str, extracted_at: str) -> None:
    """Raw-text envelope of each document in a file of its own, ``X_raw.txt``; read them
    with ``read_raw_texts``."""
    name = F.regexp_replace(raw_text_file(F.col("filename")), "^raw_texts/", "")
    write_document_files(docs, folder, name, raw_text_envelope(F.col("filename"), F.col("text"), F.lit(extracted_at)))


def write_result_files(final: DataFrame, folder: str) -> None:
    """Result of each invoice in a JSON file of its own, ``X_parsed.json``, nulls
    included; read them with ``read_json_results``."""
    result = F.struct("invoiceHeader", "isCoachingInvoice", "clientCases", "clientCasesNoActivity")
    write_document_files(final, folder, F.replace(F.col("filename"), F.lit(".pdf"), F.lit("_parsed.json")),
                         F.to_json(result, {"pretty": "true", "ignoreNullFields": "false"}))


def write_ocr_text_files(ocr: DataFrame, folder: str) -> None:
    """OCR text (non-empty only) of each document in a file of its own, ``X_ocr.txt``;
    read them with ``read_raw_texts(..., suffix="_ocr.txt")``."""
    write_document_files(ocr.where(F.length("text") > 0), folder,
                         F.replace(F.col("filename"), F.lit(".pdf"), F.lit("_ocr.txt")), F.col("text"))


def write_json_lines(df: DataFrame, path: str, keep_nulls: bool = True, compression: str = "none") -> None:
    """JSON lines; nulls are written as ``null`` (Spark omits them by default)."""
    (df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower())
     .option("compression", compression).json(path))


def write_results(final: DataFrame, path: str) -> None:
    """One JSON result per invoice (as JSON lines keyed by output file); read them
    with ``read_result_lines``."""
    out = final.select(F.replace(F.col("filename"), F.lit(".pdf"), F.lit("_parsed.json"))
                       .alias("output_file"), "invoiceHeader", "isCoachingInvoice", "clientCases",
                       "clientCasesNoActivity")
    write_json_lines(out, path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Manifest entries as JSON lines (``documents.manifest_rows``), gzipped."""
    write_json_lines(manifest.drop("doc_id"), path, compression="gzip")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """Metadata as JSON lines of (filename, meta) (``documents.metadata_record``), gzipped:
    names and values repeat from line to line, so plain lines take many times the room."""
    fields = [c for c in metadata.columns if c not in ("doc_id", "filename")]
    write_json_lines(metadata.select("filename", F.struct(*fields).alias("meta")), path, compression="gzip")


def write_ocr_texts(ocr: DataFrame, path: str) -> None:
    """OCR text per document (non-empty only), named ``X_ocr.txt``."""
    (ocr.where(F.length("text") > 0)
     .select(F.replace(F.col("filename"), F.lit(".pdf"), F.lit("_ocr.txt")).alias("ocr_file"), "text")
     .write.mode("overwrite").parquet(path))
