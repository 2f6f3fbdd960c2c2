import random
import re
from collections import Counter
from pathlib import Path

import duckdb

from invoxa.llm import licenses


def slow(text, least):
    """All units compared with all templates."""
    def dice(a, b):
        a, b = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
        return 2.0 * sum((a & b).values()) / (sum(a.values()) + sum(b.values()))

    lines = licenses.words_of_lines((text or "").encode())
    paragraphs, run = [], []
    for at, words in enumerate([*lines, []]):
        if words:
            run.append(at)
        elif run:
            paragraphs.append(run)
            run = []
    units = [("line", [at]) for at, w in enumerate(lines) if w] + [("paragraph", p) for p in paragraphs if len(p) > 1]
    units += [("text", sum(paragraphs, []))] if len(paragraphs) > 1 else []
    out = []
    for unit, ats in units:
        words = [w for at in ats for w in lines[at]]
        scores = [(-dice(words, [w for x in licenses.words_of_lines(t.encode()) for w in x]), n)
                  for n, t in licenses.TEMPLATES if len(words) > 1]
        if scores and -min(scores)[0] >= least:
            out.append((unit, ats[0] + 1, ats[-1] + 1, min(scores)[1], -min(scores)[0]))
    return out


def some_texts():
    r = random.Random(4)
    out = [None, "", "\n\n", "MIT", "Released under the MIT License.", "released UNDER the mit-license\n\nReleased under the MIT License"]
    for _ in range(150):
        words = r.choice(licenses.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(["the", "é", "License", "x"])
        for _ in range(r.randint(0, 3)):
            words.insert(r.randrange(len(words)), r.choice(["\n", "\n\n", "software"]))
        out.append(("some prose before it\n" if r.random() < 0.5 else "") + " ".join(words))
    return out


def test_against_all_templates(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least in (0.5, 0.8, 1.0):
        got = {(r.doc_id, r.unit, r.first_line, r.last_line, r.license, r.dice) for r in licenses.scan_licenses(df, least=least).collect()}
        assert got == {(i, *hit) for i, t in enumerate(texts) for hit in slow(t, least)}
        assert got


def test_sql_gives_the_same(spark):
    texts = some_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    db = duckdb.connect()
    documents = df.toPandas()
    db.register("documents", documents)
    want = db.sql(licenses.oracle_sql()).fetchall()
    got = licenses.scan_licenses(df).select("doc_id", "unit", "first_line", "last_line", "license", "dice").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_rows(odd_docs, no_docs):
    assert licenses.scan_licenses(odd_docs).count() == 0
    assert licenses.scan_licenses(odd_docs, templates=(("x", "one two"), ("none", ""), ("a", "one two"))).select(
        "doc_id", "license").collect() == [(6, "a")]
    assert licenses.scan_licenses(no_docs).count() == 0


def slow_runs(words, name, template, least):
    """(score, first bigram, last bigram) by trying all runs of words, best first."""
    want = [w for x in licenses.words_of_lines(template.encode()) for w in x]
    of_name = name.lower().replace("-", " ").replace(".", " ").encode().split()
    want, pairs = Counter(zip(want, want[1:])), list(zip(words, words[1:]))
    size = sum(want.values())
    stated = [[x for x in want if (x[0] == n and x[1] in [*of_name, b"version", b"v"]) or (x[1] == n and x[0] in [*of_name, b"version", b"v"])]
              for n in of_name if n.isdigit()]
    tried = []
    for a in range(len(pairs)):
        for b in range(a, len(pairs)):
            has = Counter(pairs[a:b + 1])
            score = 2.0 * sum((has & want).values()) / (b - a + 1 + size)
            if score >= least and all(any(has[x] for x in some) for some in stated if some):
                tried.append((-score, a, b))
    out = []
    for score, a, b in sorted(tried):
        if all(b < x or y < a for _, x, y in out):
            out.append((-score, a, b))
    return sorted(out)


def test_runs_against_all_runs():
    r = random.Random(9)
    some = [(n, t) for n, t in licenses.TEMPLATES if len(t.split()) < 60]
    assert any(len(t.split()) > 25 and any(c.isdigit() for c in n) for n, t in some)
    hits = 0
    for least in (0.5, 0.8, 1.0):
        scanner = licenses.Scanner(licenses.TEMPLATES, least)
        for _ in range(60):
            name, template = r.choice(some)
            text = " ".join(r.choice(["some", "prose", "under the", template, template, " ".join(template.split()[:r.randint(1, 9)]),
                                      " ".join(re.sub(r"[0-9]", "7", template).split()[r.randint(0, 3):])])
                            for _ in range(r.randint(1, 5)))
            words = licenses.words_of_lines(text.encode())[0]
            pairs = [(i, b) for i, b in enumerate(zip(words, words[1:])) if b in scanner.holders]
            at = licenses.TEMPLATES.index((name, template))
            got = sorted(x[:3] for x in scanner.runs_of(at, pairs))
            assert got == slow_runs(words, name, template, least), text
            hits += len(got)
    assert hits > 100


def test_notices_inside_lines_and_paragraphs(spark):
    gpl = next(t for n, t in licenses.TEMPLATES if n == "GPL-3.0" and "free software" in t)
    apache = next(t for n, t in licenses.TEMPLATES if n == "Apache-2.0" and "AS IS" in t)
    header = "".join(f"# {' '.join(apache.split()[i:i + 9])}\n" for i in range(0, len(apache.split()), 9))
    prose = "many other words of this long document " * 40
    texts = ["Copyright 2024 Acme. Released under the MIT License.",
             "Licensed under CC BY-NC 4.0. All other rights reserved.",
             prose + gpl + " " + prose,
             header + "import os\n" * 200,
             "a line before\nand this work is licensed under a Creative Commons\nAttribution 4.0 International License. A line\nafter it",
             "Licensed under CC BY-NC 3.0. All other rights reserved.", prose,
             prose + "Released under the MIT License. " + prose + "\n\nLicensed under CC BY-SA 4.0.\n" + prose + "Licensed under CC BY 4.0."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(df, runs=True).where("unit <> 'line'").collect()
    assert sorted(r[:5] for r in got) == [
        (0, "words", 1, 1, "MIT"), (1, "words", 1, 1, "CC-BY-NC-4.0"), (2, "words", 1, 1, "GPL-3.0"),
        (3, "words", 1, header.count("\n"), "Apache-2.0"), (4, "words", 2, 3, "CC-BY-4.0"), (7, "words", 1, 1, "MIT"), (7, "words", 4, 4, "CC-BY-4.0")]
    assert all(r.dice > 0.95 for r in got)
    # rows of whole units stay as they are, and no run repeats them
    units = licenses.scan_licenses(df).collect()
    assert sorted(licenses.scan_licenses(df, runs=True).where("unit <> 'words'").collect()) == sorted(units)
    whole = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(licenses.TEMPLATES)], "doc_id long, text string")
    assert licenses.scan_licenses(whole, runs=True).where("unit = 'words'").count() == 0


DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
CLAUSES = """Copyright (c) 2024, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.

"""
THIRD = """* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission.

"""
MIT = """MIT License

Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_whole_licence_files(spark):
    folder = Path(licenses.__file__).parent / "license_texts"
    files = {p.name[:-4]: p.read_text() for p in folder.glob("*.txt")}
    assert sorted(files) == ["AGPL-3.0", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    files |= {"BSD-2-Clause": CLAUSES + DISCLAIMER, "BSD-3-Clause": CLAUSES + THIRD + DISCLAIMER, "MIT": MIT}
    names = list(files)
    # whole files, then the same inside a long text
    texts = list(files.values()) + ["some prose before\n\n" * 4000 + t + "some prose after\n" * 4000 for t in files.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(df, runs=True).collect()
    for i, name in enumerate(names):
        assert [r.license for r in got if r.doc_id == i and r.unit == "text"] == [name]
        inside = [r for r in got if r.doc_id == i + len(names) and r.license == name]
        lines = texts[i].count("\n")
        assert max(r.last_line - r.first_line for r in inside) > 0.7 * lines, name
        assert {r.license for r in got if r.doc_id % len(names) == i and r.last_line - r.first_line > 0.5 * lines} == {name}


def test_lesser_and_affero_notices(spark):
    texts = [f"Licensed under the GNU {k} Public License, version {v}." for k, v in
             (("General", "3"), ("Lesser General", "3"), ("Affero General", "3"), ("Lesser General", "2.1"), ("General", "2"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licenses.scan_licenses(df, runs=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license) for r in got] == list(enumerate(["GPL-3.0", "LGPL-3.0", "AGPL-3.0", "LGPL-2.1", "GPL-2.0"]))


def test_runs_need_the_version_whatever_the_size(spark):
    """A notice of another version is no notice of this one, in short templates and long ones."""
    def states(name, text):
        words = [w for x in licenses.words_of_lines(text.encode()) for w in x]
        return licenses.version_bigrams(name, zip(words, words[1:]))

    asked = [(n, t) for n, t in licenses.TEMPLATES if states(n, t)]
    assert licenses.version_bigrams("BSD-3-Clause", [(b"3", b"neither"), (b"3", b"clause")]) == [{(b"3", b"clause")}]
    assert any(len(t.split()) < 16 for _, t in asked) and any(len(t.split()) > 25 for _, t in asked)
    prose = "many other words of this long document " * 20
    for change, found in ((lambda t: t, True), (lambda t: re.sub(r"[0-9]+", "77", t), False)):
        texts = [prose + change(t) + " " + prose for _, t in asked if len(t) < 3000]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {(r.doc_id, r.license) for r in licenses.scan_licenses(df, runs=True).where("unit = 'words'").collect()}
        want = {(i, n) for i, (n, _) in enumerate((n, t) for n, t in asked if len(t) < 3000)}
        assert (want <= got) if found else not want & got
