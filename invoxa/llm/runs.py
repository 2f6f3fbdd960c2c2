"""Periodic runs of words: a suffix automaton whose suffix-link tree is a link-cut tree.

Each preferred path of the tree holds the states whose strings last ended at one and the
same word. Appending a word recolours the path from its state to the root; on the way each
piece of an older path gives the place ``e`` where a suffix of up to ``L`` words ended
before. A distance ``d = i - e`` of at most ``L`` is a square that ends at word ``i``, and
the stretch of ``L + d`` words up to ``i`` has the smallest period ``d``; its end moves
with the words appended.

A word of a run, after the run's first period, stands at most one period after its last
occurrence. Stretches of words without enough such neighbours hold no run; the automaton
gets the rest, so ordinary prose costs one dictionary lookup a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import byte_texts, no_cycles, slices

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept string"


class Squares:
    """Suffix automaton of a growing word sequence. Lists are indexed by state; ``up`` is
    the parent in a path's splay tree or, for its root, the state above the path."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.length, self.link = [0], [-1]
        self.up, self.left, self.right, self.ended = [-1], [-1], [-1], [-1]
        self.state = self.words = 0

    def _new(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        for a in (self.up, self.left, self.right, self.ended):
            a.append(-1)
        return len(self.length) - 1

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            child = left[y] = right[x]
            right[x] = y
        else:
            child = right[y] = left[x]
            left[x] = y
        if child >= 0:
            up[child] = y
        up[y], up[x] = x, z
        if z >= 0 and left[z] == y:
            left[z] = x
        elif z >= 0 and right[z] == y:
            right[z] = x
        else:  # y was the root, which holds the path's colour
            self.ended[x] = self.ended[y]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)

    def _extend(self, word) -> None:
        moves, link, length = self.next, self.link, self.length
        new = self._new(self.words + 1, {}, -1)
        p = self.state
        while p >= 0 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        above = 0
        if p >= 0:
            above = q = moves[p][word]
            if length[p] + 1 != length[q]:
                # The copy stands right above q and was last seen with it.
                above = self._new(length[p] + 1, dict(moves[q]), link[q])
                self._splay(q)
                self.left[above], self.left[q], self.up[above] = self.left[q], above, q
                if self.left[above] >= 0:
                    self.up[self.left[above]] = above
                link[q] = above
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = above
                    p = link[p]
        link[new] = self.up[new] = above
        self.state = new

    def append(self, word) -> Iterator[tuple[int, int]]:
        """Adds a word; yields (period, length) of the longest stretch with that smallest
        period that ends here, for each square that ends here."""
        self._extend(word)
        i = self.words
        self.words += 1
        below, x = -1, self.state
        while x >= 0:
            self._splay(x)
            e = self.ended[x]
            if e >= 0 and i - e <= self.length[x]:
                yield i - e, self.length[x] + i - e
            if (cut := self.right[x]) >= 0:
                self.ended[cut] = e
            self.right[x] = below
            below, x = x, self.up[x]
        self._splay(self.state)
        self.ended[self.state] = i


def candidate_stretches(words: list, least: int, times: int) -> list[tuple[int, int]]:
    """Disjoint ranges of words outside which no run lies. A run of period q and length
    n has n - q words in a row, at least (times - 1) * q of them, each at most q after its
    last occurrence; a range without that many is split at words with none so near."""
    n = len(words)
    if n < least or len(set(words)) * times > n * times - (times - 1) * least:
        return []
    last: dict = {}
    near = []
    for i, w in enumerate(words):
        near.append(i - last.get(w, -n - 1))
        last[w] = i
    near = np.array(near)
    todo, found = [(0, n, n // times)], []
    while todo:
        a, b, most = todo.pop()
        edges = np.flatnonzero(np.diff(near[a:b] <= most, prepend=False, append=False)) + a
        for x, y in edges.reshape(-1, 2).tolist():
            period = min(most, (y - x) // (times - 1))
            if period < 1 or (y - x) * times < (times - 1) * least:
                continue
            if near[x:y].max() > period:
                todo.append((x, y, period))
            else:
                found.append((max(0, x - period), y))
    merged: list[tuple[int, int]] = []
    for x, y in sorted(found):
        if merged and x < merged[-1][1]:
            merged[-1] = merged[-1][0], max(y, merged[-1][1])
        else:
            merged.append((x, y))
    return merged


def runs_of(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run: a longest stretch whose smallest period fits
    at least ``times`` times into it and that has at least ``least`` words."""
    runs = set()
    for a, b in candidate_stretches(words, least, times):
        squares = Squares()
        ends: dict[tuple[int, int], int] = {}
        for i in range(a, b):
            for period, length in squares.append(words[i]):
                if length >= least and length >= times * period:
                    ends[i + 1 - length, period] = i + 1
        for (start, period), end in ends.items():  # to the words outside the range
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while end < len(words) and words[end] == words[end - period]:
                end += 1
            runs.add((start, end - start, period))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, change: Callable[[int | None, list], list] | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and kept (the
    words left once each run is cut to its first period, joined by one space) of each row.

    Words are parts between the six ASCII white-space characters. ``change`` gets a row's
    id and words and returns the words to search. A null, empty or blank text has no word
    and no run; repeated rows and null ids are judged row by row; other columns are left
    out; an empty table gives no row. Rows are independent: no shuffle. A task holds about
    half a kilobyte for each word of the longest candidate stretch of its documents.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), byte_texts(batch.column(1))
            for a, b in slices([len(t or b"") for t in texts], 4 << 20):
                n_words, runs, kept = [], [], []
                for doc, text in zip(ids[a:b], texts[a:b]):
                    words = (text or b"").split()
                    if change and words:
                        words = change(doc, words)
                    with no_cycles():
                        found = runs_of(words, least, times)
                    n_words.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    kept.append(b" ".join(collapse(words, found)))
                struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b], pa.int64()), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(struct)),
                     pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)
