"""Registry matching and per-document verdict.

The registry is looked up by one equi-join on the canonical form, against ``ref_canon``
(canonical form -> candidates in file order). A registered code is among the candidates of
its own form, so the same row tells exact (case-sensitive) membership. Spark broadcasts the
table if it is under its byte threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from invoxa.functions.codes import (STATUS_AMBIGUOUS, STATUS_EXACT, STATUS_FUZZY,
                                    STATUS_UNKNOWN, canonical_code, match_record)
from invoxa.functions.patterns import strip_ws
from invoxa.session import materialize

# FIXED VALUES: verdicts and their reason texts.
VERDICT_ACCEPT, VERDICT_REVIEW, VERDICT_REJECT = "accept", "needs_review", "reject"
REASON_NO_CODES = "No clientCaseNumbers found; likely not a coaching invoice"
REASON_ACCEPT = "All clientCaseNumbers are known and match exactly"
REASON_REJECT = ("The invoice contains clientCaseNumbers that are either unknown or ambiguous. "
                 "The sender must update the invoice with valid CCNs.")
REASON_REVIEW = ("Invoice contains clientCaseNumbers with historical character errors "
                 "(e.g., 1/I or 0/O swaps). Characters “1” and “0” have now "
                 "been auto-corrected to “I” and “O.”")
STATUSES = (STATUS_EXACT, STATUS_FUZZY, STATUS_UNKNOWN, STATUS_AMBIGUOUS)

#: How many of the most frequent codes are spread, and over how many parts each.
HEAVY_CODES, SALTS = 1000, 64

#: Where a registry row stands: struct(file, block, row), compared in this order.
FILE_ORDER = "_file_order"


def ref_codes(registry: DataFrame, column: str | None = None) -> DataFrame:
    """(code, canon) from a registry table: trimmed, blanks skipped.

    ``column`` defaults to ``clientCaseNumber`` when present, else the first
    column. Duplicates are kept (they matter to ``ref_canon``), and so is the
    rows' place, if the table has a column ``FILE_ORDER``.
    """
    order = [c for c in registry.columns if c == FILE_ORDER]
    names = [c for c in registry.columns if c != FILE_ORDER]
    if column is None:
        column = "clientCaseNumber" if "clientCaseNumber" in names else (names[0] if names else None)
    if column is None:
        raise ValueError("registry has no columns")
    code = strip_ws(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return (registry.select(code.alias("code"), *order).where(F.col("code") != "")
            .select("code", canonical_code(F.col("code")).alias("canon"), *order))


def ref_canon(codes: DataFrame) -> DataFrame:
    """(canon, candidates, n) per canonical form.

    ``candidates`` holds a code for each of the form's registry rows, in file
    order (without ``FILE_ORDER``: by code), and ``n`` counts them: a code listed
    twice makes its form ambiguous. Rows are first put together to runs of one
    code, inside a file block (without an order: all rows of a code), so no task
    gets all rows of a form that is repeated very often; only the runs are
    gathered for each form.
    """
    if FILE_ORDER in codes.columns:
        at = F.col(FILE_ORDER)
        rows = codes.select("canon", "code", F.struct(at["file"], at["block"]).alias("_block"), at["row"].alias("_row"))
        in_block = Window.partitionBy("canon", "_block").orderBy("_row")
        starts = (~F.lag("code").over(in_block).eqNullSafe(F.col("code"))).cast("int")
        runs = (rows.withColumn("_starts", starts).withColumn("_run", F.sum("_starts").over(in_block))
                .groupBy("canon", "_block", "_run").agg(F.min("code").alias("code"), F.count(F.lit(1)).alias("_k"))
                .select("canon", F.struct("_block", "_run", "code", "_k").alias("_of"), "_k"))
    else:
        runs = (codes.groupBy("canon", "code").agg(F.count(F.lit(1)).alias("_k"))
                .select("canon", F.struct("code", "_k").alias("_of"), "_k"))
    per_form = runs.groupBy("canon").agg(F.array_sort(F.collect_list("_of")).alias("_runs"), F.sum("_k").alias("n"))
    repeated = F.transform("_runs", lambda r: F.array_repeat(r["code"], r["_k"].cast("int")))
    return per_form.select("canon", F.flatten(repeated).alias("candidates"), "n")


def lookup_tables(registry_codes: DataFrame) -> DataFrame:
    """Lookup table for ``match_codes``, by canonical form. No hint and no counting job:
    Spark broadcasts it if its statistics, before or at run time, are under its
    byte threshold."""
    return ref_canon(registry_codes).select(F.col("canon").alias("_canon_key"),
                                            F.col("candidates").alias("_candidates"),
                                            F.col("n").alias("_n"))


def match_codes(df: DataFrame, code_col: str, lookups: DataFrame,
                out: str = "match") -> DataFrame:
    """Add ``out`` = match record of ``code_col`` (NULL code -> NULL record).

    One left equi-join on the canonical form, then one ``when`` chain: two equal codes have
    equal forms, so a code is registered if and only if it is among its form's candidates. A
    lookup under Spark's broadcast threshold leaves the input's partitioning as it is; a
    larger one shuffles each occurrence once.
    """
    # Stripped on both sides of the join, so that the code itself is shuffled once.
    original = F.col("_orig")
    x = (df.withColumn("_canon", canonical_code(strip_ws(F.col(code_col))))
         .join(lookups, F.col("_canon") == F.col("_canon_key"), "left")
         .withColumn("_orig", strip_ws(F.col(code_col))))
    exact = F.coalesce(F.array_contains("_candidates", original), F.lit(False))
    rec = match_record(original, exact, F.col("_candidates"), F.col("_n"))
    return (x.withColumn(out, F.when(F.col(code_col).isNotNull(), rec))
            .drop("_orig", "_canon", "_canon_key", "_candidates", "_n"))


def match_codes_once(df: DataFrame, code_col: str, lookups: DataFrame,
                     out: str = "match", spread: str = "doc_id") -> DataFrame:
    """``match_codes`` by a dictionary: each distinct code is matched once, and the records
    are joined back by code. For registries too large to broadcast, with codes that fill much
    of the table: here the lookup shuffles distinct codes, and the occurrences are shuffled
    once, the frequent ones spread.

    A code may fill much of the table: the ``HEAVY_CODES`` most frequent ones are spread over
    ``SALTS`` parts by the hash of column ``spread``, and their records copied to each part.
    What is broadcast to mark them is that many 8-byte hashes (a code that shares a hash with
    one of them is spread as well). ``df`` is read twice; let it be a written table.
    """
    code = F.col(code_col)
    counts = df.where(code.isNotNull()).groupBy(code.alias("_code")).agg(F.count(F.lit(1)).alias("_k"))
    heavy = (counts.orderBy(F.desc("_k"), "_code").limit(HEAVY_CODES)
             .select(F.xxhash64("_code").alias("_hash")).distinct().withColumn("_heavy", F.lit(True)))

    def marked(x: DataFrame, of: Column) -> DataFrame:
        return x.withColumn("_hash", F.xxhash64(of)).join(F.broadcast(heavy), "_hash", "left")

    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    part = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    known = (marked(match_codes(counts.select("_code"), "_code", lookups, out), F.col("_code"))
             .select("_code", F.explode(parts).alias("_part"), out))
    x = marked(df, code).withColumn("_salt", part)
    return (x.join(known, (code == F.col("_code")) & (F.col("_salt") == F.col("_part")), "left")
            .select(*df.columns, out))


def _codes(docs: DataFrame, *keep: str) -> DataFrame:
    # The outer generator keeps Catalyst from inferring a size(...) > 0
    # filter, which would copy the extraction expression and run it twice.
    return (docs.select("doc_id", *keep, F.posexplode_outer(F.col("patterns.client_cases")).alias("case_pos", "raw_code"))
            .where(F.col("raw_code").isNotNull()))


def match_cases_once(docs: DataFrame, lookups: DataFrame) -> DataFrame:
    """``match_cases`` with each distinct code matched once. The codes are written to the
    shared checkpoint folder first, so the patterns run once."""
    return match_codes_once(materialize(_codes(docs), "codes"), "raw_code", lookups)


def match_cases(docs: DataFrame, lookups: DataFrame) -> DataFrame:
    """Long form: one row per (doc, distinct raw code) with its match record."""
    return match_codes(_codes(docs), "raw_code", lookups)


def verdict(counts: Column, has_matches: Column) -> Column:
    """struct(verdict, reason, counts) from the four status counts."""
    def rv(v: str, r: str) -> Column:
        return F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("reason"))

    bad = (counts["unknown"] > 0) | (counts["ambiguous_io_swap"] > 0)
    vr = (F.when(~has_matches, rv(VERDICT_REJECT, REASON_NO_CODES))
          .when(bad, rv(VERDICT_REJECT, REASON_REJECT))
          .when(counts["fuzzy_io_swap"] > 0, rv(VERDICT_REVIEW, REASON_REVIEW))
          .otherwise(rv(VERDICT_ACCEPT, REASON_ACCEPT)))
    return F.struct(vr["verdict"].alias("verdict"), vr["reason"].alias("reason"),
                    counts.alias("counts"))


def annotate_documents(docs: DataFrame, lookups: DataFrame | None) -> DataFrame:
    """Per document: match records, status counts, verdict and LLM context.

    Plan: the codes are exploded out of ``docs`` (Catalyst prunes that branch
    to the single client-case regex), matched through one lookup and
    aggregated per ``doc_id`` into small records; the result is joined back
    to ``docs`` on ``doc_id``. Both sides descend from the same doc_id
    shuffle, so the join adds no exchange, and the aggregation buffers never
    hold document text. The verdict needs counts only, so a plan that asks for
    no match records gathers none. ``lookups=None`` models a missing registry: no
    matches, so every document is rejected.

    Added columns: ``has_codes`` (NULL without a registry), ``matches``
    array<struct<case_pos, raw_code, match>>, ``client_case_summary`` struct(verdict, reason, counts),
    ``allowed_prompt``/``allowed_valid`` array<string>, ``correction_map``.
    """
    return _annotated(docs, None if lookups is None else _per_document(match_cases(docs, lookups)))


def annotate_coded(docs: DataFrame, lookups: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``annotate_documents`` of the documents that have codes, with ``keep`` of their columns
    only. These go along with the first code of each document, so ``docs`` is worked out once
    and nothing is joined back; let them be small and fixed by ``doc_id``."""
    first = {c: F.when(F.col("case_pos") == 0, F.col(c)) for c in keep}
    per_doc = _per_document(match_codes(_codes(docs, *keep).withColumns(first), "raw_code", lookups), *keep)
    return _annotated(per_doc.select("doc_id", *keep), per_doc, joined=True)


def _per_document(matched: DataFrame, *keep: str) -> DataFrame:
    """Match records, LLM context and status counts of each document, and the only value
    there is of each column ``keep``."""
    status = F.col("match.matchStatus")
    usable = status.isin(STATUS_EXACT, STATUS_FUZZY) & F.col("match.matchedCode").isNotNull()
    ctx = F.when(usable, F.struct("case_pos", "raw_code", F.col("match.matchedCode").alias("valid")))
    return matched.groupBy("doc_id").agg(
        *[F.max(c).alias(c) for c in keep],
        F.sort_array(F.collect_list(F.struct("case_pos", "raw_code", "match"))).alias("_m"),
        F.sort_array(F.collect_list(ctx)).alias("_ctx"), F.count(F.lit(1)).alias("_n_codes"),
        *[F.count_if(status == s).alias(f"_n_{s}") for s in STATUSES])


def _annotated(docs: DataFrame, per_doc: DataFrame | None, joined: bool = False) -> DataFrame:
    entry_t = ("array<struct<case_pos:int,raw_code:string,match:struct<matchedCode:string,"
               "matchStatus:string,matchConfidence:double,contamination:string,"
               "candidates:array<string>,notes:string>>>")
    ctx_t = "array<struct<case_pos:int,raw_code:string,valid:string>>"
    if per_doc is None:
        y = docs.select("*", F.lit(None).cast(entry_t).alias("_m"),
                        F.lit(None).cast(ctx_t).alias("_ctx"), F.lit(None).cast("long").alias("_n_codes"),
                        *[F.lit(None).cast("long").alias(f"_n_{s}") for s in STATUSES])
    else:
        y = per_doc if joined else docs.join(per_doc, "doc_id", "left")
    counts = F.struct(*[F.coalesce(F.col(f"_n_{s}"), F.lit(0)).cast("int").alias(s)
                        for s in STATUSES])
    matches = F.coalesce(F.col("_m"), F.array().cast(entry_t))
    c = F.coalesce(F.col("_ctx"), F.array().cast(ctx_t))
    has_codes = F.lit(None).cast("boolean") if per_doc is None else F.coalesce(F.col("_n_codes"), F.lit(0)) > 0
    return y.select(
        *docs.columns, has_codes.alias("has_codes"), matches.alias("matches"),
        verdict(counts, F.coalesce(F.col("_n_codes"), F.lit(0)) > 0).alias("client_case_summary"),
        F.transform(c, lambda e: e["raw_code"]).alias("allowed_prompt"),
        F.transform(c, lambda e: e["valid"]).alias("allowed_valid"),
        F.map_from_entries(F.transform(c, lambda e: F.struct(e["raw_code"], e["valid"])))
        .alias("correction_map"))


def context_lists(found: Column) -> tuple[Column, Column]:
    """Prompt list and valid list from a saved map raw code -> match record (NULL: none),
    in the map's order; they are the keys and values of the correction map."""
    usable = F.filter(F.map_entries(found), lambda e: e["value"]["matchStatus"].isin(STATUS_EXACT, STATUS_FUZZY)
                      & e["value"]["matchedCode"].isNotNull())
    none = F.array().cast("array<string>")
    return (F.coalesce(F.transform(usable, lambda e: e["key"]), none),
            F.coalesce(F.transform(usable, lambda e: e["value"]["matchedCode"]), none))


def context_from_map(found: Column) -> tuple[Column, Column, Column]:
    """``context_lists`` and the correction map."""
    prompt, valid = context_lists(found)
    return prompt, valid, F.map_from_arrays(prompt, valid)
