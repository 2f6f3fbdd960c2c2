"""Licence scan: normalised text compared with licence templates by the Dice
coefficient of their word bigrams; size bounds prune the templates to compare."""

from __future__ import annotations

import pkgutil
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoxa.llm.common import byte_texts, slices

_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution. ")
_LGPL = ("This library is free software%s you can redistribute it and/or modify it under the terms of the GNU Lesser General "
         "Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) "
         "any later version.")


def _file(name: str) -> tuple[str, str]:
    """A licence and its whole text from the package's folder ``license_texts``."""
    return name, " ".join(pkgutil.get_data("invoxa.llm", f"license_texts/{name}.txt").decode().split())


# Public licence notices and whole texts (licence, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
     'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
     "the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
     "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
     "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
     "contributors may be used to endorse or promote products derived from this software without specific prior written "
     "permission."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
     "later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
     "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
     "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", _LGPL % (";", ";", "2.1")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _LGPL % (":", ",", "3")),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD + _AS_IS),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
     'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES '
     "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
     "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
     "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
     "SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
     "and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
     'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
     "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
     "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
     "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or "
     "authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
     "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
     "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under "
     'copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
     "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
     "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
     "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more "
     "information, please refer to <https://unlicense.org>"),
    *map(_file, ("AGPL-3.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")),
)

#: A-Z lower-cased; other ASCII than letters, digits and line feeds becomes a space.
_NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c == 10 or c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of_lines(text: bytes | None) -> list[list[bytes]]:
    """Normalised words of each line."""
    return [line.split() for line in (text or b"").translate(_NORMAL).split(b"\n")]


def version_bigrams(name: str, bigrams: Iterable[tuple[bytes, bytes]]) -> list[set[tuple[bytes, bytes]]]:
    """For each number in a licence's name that the bigrams state, those that state it: the
    number beside another word of the name or "version". (The clauses of a body are numbered
    too, but do not state a version.)"""
    of_name = words_of_lines(name.encode())[0]
    beside = {*of_name, b"version", b"v"}
    pairs = set(bigrams)
    stated = [{b for b in pairs if n in b and beside.issuperset(b)} for n in dict.fromkeys(of_name) if n.isdigit()]
    return [s for s in stated if s]


class Scanner:
    """Compares word lists with templates. A template of n bigrams reaches ``least``
    only with texts of ``least / (2 - least) * n`` to ``(2 - least) / least * n``."""

    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.names, self.sizes, self.counts, self.versions = [], [], [], []
        self.holders: dict[tuple[bytes, bytes], list[tuple[int, int]]] = {}
        for at, (name, text) in enumerate(templates):
            words = [w for line in words_of_lines(text.encode()) for w in line]
            self.names.append(name)
            self.versions.append(version_bigrams(name, zip(words, words[1:])))
            self.sizes.append(max(len(words) - 1, 0))
            self.counts.append(Counter(zip(words, words[1:])))
            for bigram, n in self.counts[at].items():
                self.holders.setdefault(bigram, []).append((at, n))
        filled = [n for n in self.sizes if n]
        self.low = least / (2 - least) * min(filled, default=1) - 1e-9
        self.high = (2 - least) / least * max(filled, default=0) + 1e-9

    def common(self, hits: Iterable[tuple[bytes, bytes]]) -> Counter[int]:
        """For each template the number of its bigrams among ``hits``."""
        out: Counter[int] = Counter()
        for bigram, times in Counter(hits).items():
            for at, m in self.holders[bigram]:
                out[at] += min(times, m)
        return out

    def best(self, words: list[bytes]) -> tuple[str, float, int] | None:
        """The licence of the highest Dice coefficient from ``least`` on, of equal
        ones the smaller name; the coefficient; the template."""
        n = len(words) - 1
        if n < 1 or not self.low <= n <= self.high:
            return None
        hits = [b for b in zip(words, words[1:]) if b in self.holders]
        if 2 * len(hits) < self.least * n:  # even a template made of these alone is too far
            return None
        found = [(-2.0 * c / (n + self.sizes[at]), self.names[at], at) for at, c in self.common(hits).items()
                 if 2.0 * c / (n + self.sizes[at]) >= self.least]
        if not found:
            return None
        score, name, at = min(found)
        return name, -score, at

    def runs_of(self, at: int, hits: list[tuple[int, tuple[bytes, bytes]]]) -> list[tuple[float, int, int, set[int]]]:
        """(score, first bigram, last bigram, places of common bigrams) of runs that
        reach ``least`` with template ``at`` and share no bigram: repeatedly the
        highest score, of equal ones the first and shortest. A run cut from a sentence
        can lack just the version, so it must have a bigram of each of the template's
        ``version_bigrams``, whatever the template's size."""
        counts, size = self.counts[at], self.sizes[at]
        hits = [(i, b) for i, b in hits if b in counts]
        where = np.array([i for i, _ in hits], np.int64)
        # A bigram counts in a run that starts after this place; else it is there too often.
        after, seen = np.full(len(hits), -1, np.int64), {}
        for k, (i, b) in enumerate(hits):
            before = seen.setdefault(b, [])
            if len(before) >= counts[b]:
                after[k] = before[-counts[b]]
            before.append(i)
        # For each number the place among the hits of the next one that states it.
        following = []
        for v in self.versions[at]:
            holding = np.flatnonzero([b in v for _, b in hits])
            following.append(np.append(holding, len(hits))[np.searchsorted(holding, np.arange(len(hits)))])
        complete = np.max(following, axis=0) if following else np.arange(len(hits))
        most = int((2 - self.least) / self.least * size + 1e-9)
        ends = np.searchsorted(where, where + most)

        def longest(k: int, stop: int) -> tuple[float, int, int, int] | None:
            """The best run from hit ``k`` on that ends before hit ``stop``."""
            part = slice(k, min(int(ends[k]), stop))
            fits = after[part] < where[k]
            scores = 2.0 * np.cumsum(fits) / (where[part] - where[k] + 1 + size)
            scores[:int(complete[k]) - k] = 0.0  # runs that end before they hold every number
            last = int(scores.argmax())
            return (-float(scores[last]), int(where[k]), k, k + last) if scores[last] >= self.least else None

        enough = np.flatnonzero(ends - np.arange(len(hits)) >= self.least / (2 - self.least) * size - 1e-9)
        queue = [r for k in enough.tolist() if (r := longest(k, len(hits)))]
        heapify(queue)
        out, taken = [], []
        while queue:
            score, _, first, last = heappop(queue)
            after_it = bisect_right(taken, (first, len(hits)))
            if after_it and taken[after_it - 1][1] >= first:
                continue
            if after_it < len(taken) and taken[after_it][0] <= last:
                if r := longest(first, taken[after_it][0]):
                    heappush(queue, r)
                continue
            insort(taken, (first, last))
            part = where[first:last + 1]
            out.append((-score, int(part[0]), int(part[-1]), set(part[after[first:last + 1] < part[0]].tolist())))
        return out

    def runs(self, lines: list[list[bytes]], units: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int, str, float]]:
        """Rows of unit ``words``: runs that match wherever they stand in the text.

        ``units`` are the matches (first word, end, template) of whole units. The
        more bigrams a run has in common, the earlier it is taken; a run is left
        out if at least half of them belong to a unit or a run before it.
        """
        words = [w for line in lines for w in line]
        hits = [(i, b) for i, b in enumerate(zip(words, words[1:])) if b in self.holders]
        found = [(-len(places), -score, self.names[at], first, last, places)
                 for at, c in self.common(b for _, b in hits).items()
                 if 2.0 * c / (c + self.sizes[at]) >= self.least - 1e-9
                 for score, first, last, places in self.runs_of(at, hits)]
        if not found:
            return
        used: set[int] = set()
        for start, end, at in units:
            left = Counter(self.counts[at])
            for i, b in hits[bisect_right(hits, (start,)):bisect_right(hits, (end - 1,))]:
                if left[b] > 0:
                    left[b] -= 1
                    used.add(i)
        line_of = np.repeat(np.arange(1, len(lines) + 1), [len(line) for line in lines])
        kept = []
        for _, score, name, first, last, places in sorted(found, key=lambda r: r[:5]):
            if 2 * len(used & places) < len(places):
                used |= places
                kept.append((first, last, name, -score))
        for first, last, name, score in sorted(kept):
            yield "words", int(line_of[first]), int(line_of[last + 1]), name, score

    def scan(self, text: bytes | None, runs: bool = False) -> Iterator[tuple[str, int, int, str, float]]:
        """(unit, first line, last line, licence, score) of each unit that matches:
        lines; paragraphs of several lines; the text if of several paragraphs; with
        ``runs`` also the runs of words inside them. Lines count from 1; lines
        without a word end a paragraph."""
        lines = words_of_lines(text)
        starts = [0]  # of each line, in words of the text
        for words in lines:
            starts.append(starts[-1] + len(words))
        matched: list[tuple[int, int, int]] = []
        paragraphs: list[list[int]] = [[]]
        for at, words in enumerate(lines):
            if not words:
                if paragraphs[-1]:
                    paragraphs.append([])
                continue
            paragraphs[-1].append(at)
            if found := self.best(words):
                matched.append((starts[at], starts[at + 1], found[2]))
                yield "line", at + 1, at + 1, *found[:2]
        paragraphs = [p for p in paragraphs if p]
        units = [("paragraph", p) for p in paragraphs if len(p) > 1]
        if len(paragraphs) > 1:
            units.append(("text", [at for p in paragraphs for at in p]))
        for unit, ats in units:
            if starts[ats[-1] + 1] - starts[ats[0]] - 1 > self.high:  # most are too long; no need to join them
                continue
            if found := self.best([w for at in ats for w in lines[at]]):
                matched.append((starts[ats[0]], starts[ats[-1] + 1], found[2]))
                yield unit, ats[0] + 1, ats[-1] + 1, *found[:2]
        if runs:
            yield from self.runs(lines, matched)


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8,
                  id_col: str = "doc_id", text_col: str = "text", runs: bool = False) -> DataFrame:
    """One row per unit of a text that matches a licence: doc_id, unit, first_line,
    last_line, license, dice. See ``Scanner.scan`` for the units; ``runs`` also finds
    notices among other words of a line, paragraph or text (unit ``words``).

    ``templates`` is a list of (licence, text), of some hundred kB, that travels with the function.
    Null, empty and wordless texts match nothing; bigrams count as often as they
    occur; one-word units have none. Ids may be null or repeat; other columns are
    dropped, whatever their names. No shuffle.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in batches:
            texts, ids = byte_texts(batch.column(1)), batch.column(0).to_pylist()
            for a, b in slices([len(t or b"") for t in texts], 1 << 23):
                rows = [(i, *hit) for i, t in zip(ids[a:b], texts[a:b]) for hit in scanner.scan(t, runs)]
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(),
                                                             pa.float64()))],
                    names=["doc_id", "unit", "first_line", "last_line", "license", "dice"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, unit string, first_line int, last_line int, license string, dice double")


def oracle_sql(templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8) -> str:
    """DuckDB SQL for the rows of ``scan_licenses`` on the view ``documents``, without
    ``runs``: lines, paragraphs and texts."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    values = ", ".join(f"({i}, {quoted(n)}, {quoted(t)})" for i, (n, t) in enumerate(templates))
    normal = (r"regexp_replace(translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              r"'[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]', ' ', 'g')")
    words = "list_filter(string_split(%s, ' '), lambda x: x <> '')"
    bigrams = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    return f"""
WITH t0(tid, license, body) AS (VALUES {values}),
t AS (SELECT tid, license, {words % (normal % 'body')} AS words FROM t0),
tb AS (SELECT tid, b, row_number() OVER (PARTITION BY tid, b) AS k FROM (SELECT tid, unnest({bigrams}) AS b FROM t)),
size AS (SELECT tid, license, len(words) - 1 AS n FROM t WHERE len(words) > 1),
lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS ln
          FROM (SELECT doc_id, string_split({normal % "coalesce(text, '')"}, chr(10)) AS l FROM documents)),
w AS (SELECT doc_id, ln, {words % 'line'} AS words FROM lines),
p AS (SELECT *, sum(CASE WHEN len(words) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) AS par FROM w),
u AS (SELECT doc_id, 'line' AS unit, ln AS first_line, ln AS last_line, words FROM w WHERE len(words) > 0
      UNION ALL
      SELECT doc_id, 'paragraph', min(ln), max(ln), flatten(list(words ORDER BY ln)) FROM p WHERE len(words) > 0
      GROUP BY doc_id, par HAVING count(*) > 1
      UNION ALL
      SELECT doc_id, 'text', min(ln), max(ln), flatten(list(words ORDER BY ln)) FROM p WHERE len(words) > 0
      GROUP BY doc_id HAVING count(DISTINCT par) > 1),
near AS (SELECT doc_id, unit, first_line, last_line, words, len(words) - 1 AS n FROM u
         WHERE EXISTS (SELECT 1 FROM size s WHERE len(words) - 1 BETWEEN {least} / (2 - {least}) * s.n - 1e-9
                                                                    AND (2 - {least}) / {least} * s.n + 1e-9)),
ub AS (SELECT doc_id, unit, first_line, last_line, n, b,
              row_number() OVER (PARTITION BY doc_id, unit, first_line, last_line, b) AS k
       FROM (SELECT doc_id, unit, first_line, last_line, n, unnest({bigrams}) AS b FROM near)),
hit AS (SELECT doc_id, unit, first_line, last_line, ub.n, tid, count(*) AS c FROM ub JOIN tb USING (b, k) GROUP BY ALL),
d AS (SELECT doc_id, unit, first_line, last_line, license, 2.0::DOUBLE * c / (hit.n + size.n) AS dice FROM hit JOIN size USING (tid)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, unit, first_line, last_line ORDER BY dice DESC, license) AS place
      FROM d WHERE dice >= {least})
SELECT doc_id, unit, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line, license, dice
FROM r WHERE place = 1
"""
