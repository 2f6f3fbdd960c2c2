"""Language identification by nearest centroid.

Texts become unit TF-IDF vectors of hashed character n-grams; each language has
several clustered centroids; the centroid with the largest cosine decides, and a
text farther from it than texts of its language and length are is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import ngram_counts, slices

UNDETERMINED = "und"
SIZES = (1, 2, 3)
#: Lengths, in letters and spaces, for which a limit is fitted.
LENGTHS = (64, 128, 256, 512)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters than
    letters replaced by one space; empty if there is no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    keep = _letters()[codes]
    if not keep.any():
        return codes[:0]
    first_gap = ~keep & np.concatenate(([True], keep[:-1]))
    codes = np.where(keep, codes, np.uint32(32))[keep | first_gap]
    return np.concatenate((codes[:1][codes[:1] != 32], codes[1:])) if codes[0] == 32 else codes


@dataclass
class LanguageModel:
    """``centroids``: a unit row each; ``languages``: their names; ``limits``: a row
    each, for each of ``LENGTHS`` the smallest cosine that is not rejected; ``idf``:
    a weight per bucket."""

    bits: int
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str] = field(default_factory=list)
    limits: np.ndarray = field(default_factory=lambda: np.empty((0, len(LENGTHS))))

    def vectors(self, docs: list[np.ndarray]) -> np.ndarray:
        return vectors(docs, self.idf, self.bits)

    def nearest(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Per document its nearest centroid's index and the cosine, 0 to 1."""
        cosines = vectors(docs, self.idf, self.bits) @ self.centroids.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(docs)), best].astype(np.float64), 0, 1)

    def least(self, centroid: int, length: int) -> float:
        """The smallest cosine that is not rejected: between two of ``LENGTHS`` on the
        line that joins their limits, below the first on the line from 0, so that a few
        words are kept unless they have nothing of the language; from the last on the same."""
        return float(np.interp(length, (0, *LENGTHS), (0, *self.limits[centroid])))


def vectors(docs: list[np.ndarray], idf: np.ndarray, bits: int) -> np.ndarray:
    x = np.log1p(ngram_counts(docs, SIZES, bits)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def _blocks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches with their documents' letters, a million characters
    or one document at a time."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
        for a, b in slices(lengths, 1 << 20, 256):
            part = batch.slice(a, b - a)
            yield part, [letter_codes(t) for t in part.column(text_at).to_pylist()]


def cluster(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means: unit centroids; starts from rows far from each other."""
    picks = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[picks[0]]
    while len(picks) < min(k, len(x)):
        picks.append(int(near.argmin()))
        near = np.maximum(near, x @ x[picks[-1]])
    centroids = x[picks]
    for _ in range(rounds):
        owner = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[owner == c].sum(axis=0) if (owner == c).any() else centroids[c] for c in range(len(picks))])
        centroids = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-9)
    return centroids.astype(np.float32)


def document_frequencies(texts: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Documents with a letter, and for each bucket those that contain it, over
    all rows of ``texts`` (column ``text``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(1 << bits, np.int64)
        for _, docs in _blocks(batches, 0):
            docs = [d for d in docs if len(d)]
            n += len(docs)
            df += (ngram_counts(docs, SIZES, bits) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 1 << bits)), pa.array(np.append(n, df))],
                                         names=["bucket", "n"])

    sums = (texts.select("text").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # 2 ** bits + 1 rows at most
    out = np.zeros((1 << bits) + 1, np.int64)
    for r in sums:
        out[r["bucket"]] = r["n"]
    return int(out[-1]), out[:-1]


def train(labelled: DataFrame, bits: int = 12, centroids: int = 4, most: int = 2000,
          quantile: float = 0.01, slack: float = 0.75) -> LanguageModel:
    """Fit on rows of (``text``, ``lang``); rows with a null or without a letter
    take no part.

    Document frequencies come from all rows. Centroids are fitted for each
    language, in one task each, on a sample of about ``most`` rows (at most twice
    that; those whose hash of id, if there is a ``doc_id``, text and language is
    smallest), which bounds that task.
    A language's limit for a length is ``slack`` times the ``quantile`` of the cosines
    of the sample's texts cut to that length, from their middle (of whole texts, as far as none
    is that long the limit of the length before), so a long text must be much like the
    language and a short one need not.
    The model's size follows the number of languages, not of rows.
    """
    of_row = F.xxhash64(*(c for c in ("doc_id", "text", "lang") if c in labelled.columns))
    rows = labelled.select("text", "lang", (of_row.bitwiseAND(0x7FFFFFFF) / float(1 << 31)).alias("part")) \
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = dict(rows.groupBy("lang").count().collect())  # a row a language
    n, df = document_frequencies(rows, bits)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    # Looked up in place: a join would shuffle all texts by language before it drops most.
    of_lang = F.create_map(*(F.lit(x) for pair in (counts or {"": 1}).items() for x in pair))
    sample = rows.where(F.col("part") * of_lang[F.col("lang")] < most).select("lang", "part", "text")

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("text", "ascending")])
        keys = table.column(2).to_pylist()[:2 * most]
        x = np.concatenate([vectors([d for d in (letter_codes(t) for t in keys[a:b]) if len(d)], idf, bits)
                            for a, b in slices([len(t) for t in keys], 1 << 20)] or [np.empty((0, 1 << bits))])
        lang = table.column(0)[0].as_py()
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroid": pa.array([], pa.binary()),
                             "at_least": pa.array([], pa.list_(pa.float64()))})
        found = cluster(x, centroids)
        limits, pieces = [0.0] * len(LENGTHS), [[] for _ in LENGTHS]
        for text in keys:
            codes = letter_codes(text)
            for cuts, n in zip(pieces, LENGTHS):
                if len(codes) >= n:
                    cuts.append(codes[(len(codes) - n) // 2:][:n])
        for i, cuts in enumerate(pieces):
            near = np.concatenate([(vectors(cuts[a:a + 256], idf, bits) @ found.T).max(axis=1)
                                   for a in range(0, len(cuts), 256)] or [np.empty(0)])
            limits[i] = float(slack * np.quantile(near, quantile)) if len(near) else limits[i - 1] if i else 0.0
        return pa.table({"lang": pa.array([lang] * len(found), pa.string()),
                         "centroid": pa.array([c.tobytes() for c in found], pa.binary()),
                         "at_least": pa.array([limits] * len(found), pa.list_(pa.float64()))})

    got = sample.groupBy("lang").applyInArrow(fit, "lang string, centroid binary, at_least array<double>").collect()
    got.sort(key=lambda r: (r["lang"], r["centroid"]))
    return LanguageModel(bits, idf, np.stack([np.frombuffer(r["centroid"], np.float32) for r in got])
                         if got else np.empty((0, 1 << bits), np.float32),
                         [r["lang"] for r in got], np.array([r["at_least"] for r in got]).reshape(-1, len(LENGTHS)))


def _predict(model: LanguageModel, docs: list[np.ndarray]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, cosines, and whether rejected."""
    names, scores, rejected = [UNDETERMINED] * len(docs), np.zeros(len(docs)), np.ones(len(docs), bool)
    some = [i for i, d in enumerate(docs) if len(d)] if model.languages else []
    if some:
        best, cosine = model.nearest([docs[i] for i in some])
        scores[some] = cosine
        for i, c, near in zip(some, best.tolist(), cosine.tolist()):
            names[i], rejected[i] = model.languages[c], near < model.least(c, len(docs[i]))
    return names, scores, rejected


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score, rejected.

    ``score`` is the cosine to the nearest centroid. Null texts, texts without a
    letter, and every text under a model without a language get ``und``, score 0,
    rejected. A text below the limit of its centroid and length keeps the nearest language and is
    marked ``rejected``. Whole texts of any length are read in blocks. Ids may be
    null or repeat; other columns are dropped, whatever their names. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _blocks(batches, 1):
            names, scores, rejected = _predict(model, found)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)],
                names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that ``identify`` does not reject."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _blocks(batches, at):
            yield part.filter(pa.array(~_predict(model, found)[2]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3 (null: false)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows to learn from: labelled, with an id, not held out."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")
