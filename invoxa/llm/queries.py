"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from invoxa.llm import ann, bpe, crosstok, langid, licenses, packing, pii, runs, simhash, substring, suffix_tree, topk, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Host and path rules of op3.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}

#: The tree of op12.
SUFFIX_TREE = {"depth": 2, "prior": 100.0, "least": 4, "divergence": 2.0}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose fingerprints link at 2 or fewer bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every twentieth vector."""
    return ann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by rules, else by the classifier, which learns from
    urls that the rules decide."""
    pages = table(spark, sf_dir, "pages")
    model = url_filter.train(url_filter.rule_labels(pages, URL_RULES))
    return url_filter.judge_urls(pages, URL_RULES, model)


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest integer scores for every twentieth vector."""
    return topk.search(table(spark, sf_dir, "embeddings"), k=20, scale=64.0, every=20)


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), special=True)
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")),
                        F.sha2(pii.spans_text(base), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from the two thirds not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(langid.training_rows(docs))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out())


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded from its ids."""
    import public_tokenizers

    both = bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, paragraphs and texts of all documents that match a licence, and the
    notices inside them (unit ``words``, which the SQL does not have)."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), runs=True)


@query
def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 13 words that an earlier one holds."""
    found = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_crosstok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two vocabularies aligned, with corpus counts of its links."""
    rows = crosstok.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = crosstok.corpus_counts(rows.withColumn("groups_sha256", groups).drop("groups"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability, learnt from the nine tenths not held out."""
    return suffix_tree.score(table(spark, sf_dir, "documents"), suffix_tree.held_out_tenth(), **SUFFIX_TREE).drop("states")


def with_planted_period(doc: int | None, words: list) -> list:
    """Words of every tenth document (by checksum of its id) repeat from some word on."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    period = words[a:a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + [period[i % len(period)] for i in range(n - a)]


@query
def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs, the steepest of them, and the words left without repeats."""
    found = runs.find_runs(table(spark, sf_dir, "documents"), least=6, times=4, change=with_planted_period)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))

    def steeper(best, r):  # runs come by start, then period, so ties leave the first
        more = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
        return F.when(more, r).otherwise(best)

    best = F.aggregate("runs", F.expr("cast(null as struct<start: long, length: long, period: long>)"), steeper)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"))


ORACLE["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
             vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
ORACLE["op9_licenses"] = licenses.oracle_sql()
ORACLE["op10_substring"] = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
win AS (SELECT doc_id, unnest(k) AS k, generate_subscripts(k, 1) AS i
        FROM (SELECT doc_id, list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) AS k FROM d)),
fst AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
cov AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN fst USING (k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
