"""URL filter: host and path rules first, else logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import ngram_counts

ALLOW, BLOCK = "allow", "block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty if it is null or has no ``://``.

    The host runs from the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; the path from there up to ``?``, ``#`` or the end.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


class Rules:
    """Longest matching (host, path) rule. A rule such as ``example.net/en/``
    fits its host and all subdomains if the path starts with its path."""

    def __init__(self, rules: dict[str, str]):
        self.verdicts = dict(rules)
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for rule in rules:
            cut = rule.find("/")
            host, path = (rule, "") if cut < 0 else (rule[:cut], rule[cut:])
            self.by_host.setdefault(host.lower(), []).append((path, rule))

    def find(self, host: str, path: str) -> str | None:
        """The longest rule that fits; of equally long ones the longer host's,
        then the smaller text."""
        best, key = None, None
        at = 0
        while True:
            suffix = host[at:]
            for prefix, rule in self.by_host.get(suffix, ()):
                if path.startswith(prefix):
                    mine = (-len(rule), -len(suffix), rule)
                    if key is None or mine < key:
                        best, key = rule, mine
            dot = host.find(".", at)
            if dot < 0:
                return best
            at = dot + 1


@dataclass
class UrlModel:
    """Weights of one logistic regression over two hashed n-gram spaces."""

    weights: np.ndarray
    bias: float
    bits: int
    sizes: tuple[int, ...]

    def features(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        return features(hosts, paths, self.bits, self.sizes)

    def blocked(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probability that each url belongs to the blocked class."""
        return 1 / (1 + np.exp(-(self.features(hosts, paths) @ self.weights + self.bias)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f"^{text}$".encode("utf-32-le", "replace"), np.uint32)


def features(hosts: list[str], paths: list[str], bits: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Unit-length count vectors: the host's n-grams, then the path's."""
    out = [ngram_counts([_codes(x) for x in part], sizes, bits) for part in (hosts, paths)]
    x = np.concatenate(out, axis=1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)


def train(labelled: DataFrame, bits: int = 12, sizes: tuple[int, ...] = (2, 3, 4),
          most: int = 2000, rounds: int = 200, rate: float = 8.0, ridge: float = 1e-4) -> UrlModel:
    """Fit on a labelled table (``url``, ``label``: allow or block).

    The table is meant to be small; of a larger one at most ``most`` distinct
    urls of each label are used, those with the smallest hash, a bound that
    keeps the fit on the driver small. Rows with a null url or another label
    take no part. With one label only, the model always gives that label; with
    none it gives allow.
    """
    rows = []
    clean = (labelled.select(F.col("url").alias("u"), F.col("label").alias("y"))
             .where(F.col("u").isNotNull()))
    for label in (ALLOW, BLOCK):
        host, path = url_parts(F.col("u"))
        rows += (clean.where(F.col("y") == label).select(host.alias("h"), path.alias("p")).distinct()
                 .orderBy(F.xxhash64("h", "p"), "h", "p").limit(most)
                 .select("h", "p", F.lit(float(label == BLOCK)).alias("y")).collect())
    zero = np.zeros(2 << bits)
    y = np.array([r["y"] for r in rows])
    if not len(rows) or y.min() == y.max():
        return UrlModel(zero, 20.0 if len(rows) and y[0] else -20.0, bits, sizes)
    x = features([r["h"] for r in rows], [r["p"] for r in rows], bits, sizes).astype(np.float64)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels weigh the same
    w, b = zero, 0.0
    for _ in range(rounds):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * share
        w = w - rate * (x.T @ error + ridge * w)
        b -= rate * error.sum()
    return UrlModel(w, float(b), bits, sizes)


def judge_urls(pages: DataFrame, rules: dict[str, str], model: UrlModel, id_col: str = "page_id",
               url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    ``rules`` maps a rule to its verdict and is a short list that travels with
    the function; ``verdict`` is the longest matching rule's, else the
    classifier's (block if the probability ``score`` reaches ``threshold``).
    Null or unparsable urls have an empty host and path, which the classifier
    judges like any other. Ids may be null or repeat; other columns of the input
    are dropped, whatever their names. No shuffle.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Rules(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                found = [table.find(h, p) for h, p in zip(hosts, paths)]
                scores = model.blocked(hosts, paths)
                verdicts = [table.verdicts[r] if r is not None else BLOCK if s >= threshold else ALLOW
                            for r, s in zip(found, scores)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(found, pa.string()),
                     pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())],
                    names=["page_id", "host", "path", "rule", "verdict", "score"])

    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")


def rule_labels(pages: DataFrame, rules: dict[str, str], url_col: str = "url") -> DataFrame:
    """A labelled URL table (url, label) from the urls that a rule decides."""
    found = judge_urls(pages.select(F.lit(0).alias("page_id"), F.col(url_col).alias("url")), rules,
                       UrlModel(np.zeros(2 << 4), 0.0, 4, (2,)))
    return found.where(F.col("rule").isNotNull()).select(
        F.concat(F.lit("x://"), F.col("host"), F.col("path")).alias("url"), F.col("verdict").alias("label"))
