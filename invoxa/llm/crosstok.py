"""Alignment of two tokenisations of the same text.

Each text is tokenised whole by both vocabularies. Where both have a token that ends at the
same byte and both next tokens begin with a space, the document is cut: the ids between two
such anchors are a window. Windows come back all the time, so the alignment of a window is
remembered by its ids. The counts of linked id pairs over the whole corpus return to the
documents chunk by chunk: a chunk of documents asks for each of its distinct pairs once.
"""

from __future__ import annotations

import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import Memo, byte_texts, no_cycles, slices, written
from invoxa.llm.packing import byte_letters

SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
          "chunk string, links binary, pair_keys array<long>, pair_counts array<long>")

#: Marks the ids of the second vocabulary in the key of a window.
_SECOND = 1 << 31

#: Neither vocabulary has a token across a space between two characters that are no white space.
_PARTS = re.compile(r"(?<=\S) (?=\S)")


class BatchMemo(Memo):
    """A ``Memo`` whose function makes the values of many keys at once."""

    def __init__(self, batch, most: int):
        super().__init__(None, most)
        self.batch = batch

    def getter(self, keys: set):
        if self.size > self.most:
            self.before, self.now, self.size = self.now, {}, 0
        new = [k for k in keys if k not in self.now and k not in self.before]
        self.make = dict(zip(new, self.batch(new) if new else [])).__getitem__
        return super().getter(keys)


class Pair:
    """A byte-level BPE (file of ``tokenizers``) and a ``sentencepiece`` model whose first
    token takes a space before the text."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.model_a = self.a.model
        self.b = SentencePieceProcessor(model_file=pieces)
        byte = {letter: i for i, letter in enumerate(byte_letters())}
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        # Parts are encoded one by one if no piece could join two of them.
        joins = any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self.split = (lambda text: [text]) if joins else _PARTS.split
        self.length_a, self.space_a = self._facts(self.bytes_a)
        self.length_b, self.space_b = self._facts(self.bytes_b)
        # How a group's tokens are written: a comma after each but a side's last.
        self.names = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"]
        self.names += [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]
        self.parts = BatchMemo(self._parts, 24 << 20)
        self.windows = BatchMemo(self._windows, 24 << 20)

    @staticmethod
    def _facts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(t) for t in tokens], np.int64), np.array([t[:1] == b" " for t in tokens])

    def _encode_a(self, text: str) -> list[int]:
        """Ids of the text with a space before it. A plain word and the punctuation that
        closes it are one piece each for the model as it is."""
        word = text.rstrip(".,;:!?")
        if word and (word.isalpha() and max(word) < "\u0250" or word.isascii() and word.isdigit()):
            as_bytes = word if word.isascii() else "".join(map(byte_letters().__getitem__, word.encode()))
            ids = [t.id for t in self.model_a.tokenize("Ġ" + as_bytes)]
            return ids + [t.id for t in self.model_a.tokenize(text[len(word):])] if len(text) > len(word) else ids
        return self.a.encode(" " + text, add_special_tokens=False).ids

    def _parts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Packed ids of both vocabularies; none where either does not give back the text."""
        a, b = list(map(self._encode_a, texts)), self.b.encode(texts, num_threads=1)
        back_a, back_b = ([b"".join(map(token, i)) for i in ids] for ids, token in
                          ((a, self.bytes_a.__getitem__), (b, self.bytes_b.__getitem__)))
        return [(array("I", x).tobytes(), array("I", y).tobytes()) if u == v == b" " + t.encode() else (b"", b"")
                for t, x, y, u, v in zip(texts, a, b, back_a, back_b)]

    def _shared(self, a: np.ndarray, b: np.ndarray, open_a: np.ndarray, open_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each first and each second id, whether both have an end there that is open."""
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        at_a, at_b = (np.zeros(int(end_a[-1]) + 1 if len(a) else 1, bool) for _ in (0, 1))
        at_a[end_a[open_a]] = True
        at_b[end_b[open_b]] = True
        both = at_a & at_b
        return both[end_a], both[end_b]

    def _windows(self, keys: list[bytes]) -> list[tuple[str, bytes]]:
        """The groups of each window as text (with ``;`` after each), and its links (first
        id times 2 ** 32 plus second). Both sides of a window have the same bytes."""
        ids = np.frombuffer(b"".join(keys), "<u4").astype(np.int64)
        sizes = np.array([len(k) // 4 for k in keys], np.int64)
        first = ids < _SECOND
        a, b = ids[first], ids[~first] - _SECOND
        last_a, last_b = self._shared(a, b, np.ones(len(a), bool), np.ones(len(b), bool))
        group = np.concatenate([np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b])
        names = np.concatenate([2 * a + last_a, 2 * (b + len(self.bytes_a)) + last_b])
        words = list(map(self.names.__getitem__, names[np.argsort(group, kind="stable")].tolist()))
        cut = [0, *np.cumsum(sizes).tolist()]
        links = (a[last_a] << 32 | b[last_b]).astype("<i8").tobytes()
        owner = np.repeat(np.arange(len(keys)), sizes)[first]
        till = [0, *(8 * np.cumsum(np.bincount(owner[last_a], minlength=len(keys)))).tolist()]
        return [("".join(words[x:y]), links[u:v]) for x, y, u, v in zip(cut, cut[1:], till, till[1:])]

    def tokens(self, texts: list[bytes | None]) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of both vocabularies for each text; none for a null or empty text or
        one that either vocabulary does not give back byte by byte."""
        decoded = [t.decode("utf-8", "replace") if t else "" for t in texts]
        parts = [self.split(t) if t else [] for t in decoded]
        get = self.parts.getter(set().union(*parts))
        a, b = [], []
        for raw, text, words in zip(texts, decoded, parts):
            found = list(map(get, words))
            if (b"", b"") in found or (raw and raw != text.encode()):
                # Parts that differ, each for itself: only the whole text decides.
                found = self._parts([text]) if raw == text.encode() else []
            a.append(b"".join([f[0] for f in found]))
            b.append(b"".join([f[1] for f in found]))
        return a, b

    def align(self, texts: list[bytes | None]) -> list[tuple[int, int, str, np.ndarray]]:
        """(number of first ids, of second ids, groups, links) of each text."""
        tokens = self.tokens(texts)
        a, b = (np.frombuffer(b"".join(t), "<u4") for t in tokens)
        n_a, n_b = (np.array([len(x) // 4 for x in t], np.int64) for t in tokens)
        end_a, end_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        # Ends that both share and where both next tokens begin with a space; the end of a
        # document is one, since every text is tokenised with a space before it.
        is_a, is_b = self._shared(a, b, np.append(self.space_a[a[1:]], True)[:len(a)], np.append(self.space_b[b[1:]], True)[:len(b)])
        to_a, to_b = np.flatnonzero(is_a) + 1, np.flatnonzero(is_b) + 1
        # The ids of each window, first those of the first vocabulary.
        owner = np.concatenate([np.cumsum(is_a) - is_a, np.cumsum(is_b) - is_b])
        raw = np.concatenate([a, b | np.uint32(_SECOND)])[np.argsort(owner, kind="stable")].tobytes()
        cut = [0, *(4 * (to_a + to_b)).tolist()]
        keys = [raw[x:y] for x, y in zip(cut, cut[1:])]
        found = list(map(self.windows.getter(set(keys)), keys))
        last = np.searchsorted(to_a, np.cumsum(n_a), side="right").tolist()
        out = []
        for i, (w, x) in enumerate(zip([0, *last], last)):
            links = np.frombuffer(b"".join([f[1] for f in found[w:x]]), "<i8")
            out.append((int(n_a[i]), int(n_b[i]), "".join([f[0] for f in found[w:x]])[:-1], links))
        return out


@lru_cache(2)
def pair(byte_level: str, pieces: str) -> Pair:
    return Pair(byte_level, pieces)


def align(docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int = 2 << 20,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both tokenisations of each row aligned: doc_id, n_a, n_b, n_groups, n_links and groups
    (``a1,a2|b1;a3|b2,b3``), and what ``corpus_counts`` needs: the row's chunk, its links as
    packed indexes into the chunk's distinct id pairs, and, in the chunk's first row, those
    pairs (first id times 2 ** 32 plus second) and their counts, the most frequent first.

    A text that is null, empty, or that either vocabulary does not give back byte by byte
    has no tokens: zeros and an empty string. Repeated rows and null ids are aligned row by
    row; other columns are left out; an empty table gives no row. No shuffle; a task holds
    ``chunk_bytes`` of text, or one longer text, and about 200 MB of remembered parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(byte_level, pieces)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            for x, y in slices([len(t or b"") for t in texts], chunk_bytes):
                with no_cycles():
                    rows = both.align(texts[x:y])
                n_links = [len(r[3]) for r in rows]
                keys, at, counts = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True, return_counts=True)
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(keys), "<u4")
                rank[order] = np.arange(len(keys), dtype=np.uint32)
                links = np.split(rank[at], np.cumsum(n_links)[:-1])
                rest = [None] * (y - x - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[x:y], pa.int64()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int64()), pa.array(n_links, pa.int64()), pa.array(n_links, pa.int64()),
                     pa.array([r[2] for r in rows], pa.string()), pa.array([uuid.uuid4().hex] * (y - x), pa.string()),
                     pa.array([v.tobytes() for v in links], pa.binary()),
                     pa.array([keys[order].tolist(), *rest], pa.list_(pa.int64())),
                     pa.array([counts[order].tolist(), *rest], pa.list_(pa.int64()))],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def corpus_counts(aligned: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to rows of ``align`` (whose ``groups`` may be gone or
    replaced): links whose id pair is linked as often over the whole corpus as any with the
    same second id, and the sum of the links' corpus counts.

    The rows are written to the shared folder first. What is shuffled then is one row for
    each distinct pair of a chunk, both ways, and the packed links; a pair found everywhere
    has one row a chunk, not one a link."""
    docs = written(aligned, "aligned")
    asked = docs.where("pair_keys IS NOT NULL").select(
        "chunk", F.explode(F.arrays_zip("pair_keys", "pair_counts")).alias("p")).select(
        "chunk", F.col("p.pair_keys").alias("pair"), F.col("p.pair_counts").alias("n"))
    totals = asked.groupBy("pair").agg(F.sum("n").alias("n"))
    second = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b")
    tops = totals.groupBy(second).agg(F.max("n").alias("top"))
    totals = totals.withColumn("b", second).join(tops, "b").select("pair", F.col("n").alias("total"), (F.col("n") == F.col("top")).alias("best"))
    told = asked.select(F.col("chunk").alias("asker"), "pair").join(totals, "pair")

    names = [c for c in docs.columns if c not in ("chunk", "links", "pair_keys", "pair_counts")]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", n_best long, count_sum long"

    def work(rows: pa.Table, answers: pa.Table) -> pa.Table:
        first = next((k for k in rows["pair_keys"] if k.is_valid), None)
        order = np.array(first.as_py() if first is not None else [], np.int64)
        pairs = answers["pair"].to_numpy()
        at = np.argsort(pairs)
        at = at[np.searchsorted(pairs[at], order)]
        total, best = answers["total"].to_numpy()[at], answers["best"].to_numpy(zero_copy_only=False)[at]
        sums, bests = [], []
        for links in rows["links"].to_pylist():
            i = np.frombuffer(links, "<u4")
            sums.append(int(total[i].sum()))
            bests.append(int(best[i].sum()))
        kept = rows.select(names)
        return kept.append_column("n_best", pa.array(bests, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    return docs.drop("pair_counts").groupBy("chunk").cogroup(told.groupBy("asker")).applyInArrow(work, schema)
