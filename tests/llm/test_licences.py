import re
from collections import Counter
from math import floor, sqrt

import duckdb

from bidloom.llm import licences
from bidloom.llm.licence_texts import TEXTS

from .helpers import odd_docs, odd_rows, prose


def brute(rows, threshold=licences.THRESHOLD):
    """rows: (id, path, text)."""
    table, other = licences.idf()
    templates = {}
    for k, name, title, t, w, _ in licences.weights():
        templates.setdefault((k, name, title), {})[t] = w

    def best(unit):
        lower = "".join(c.lower() if c.isascii() else c for c in unit)
        terms = [t for t in re.findall(licences.TERM, lower) if t not in licences.STOP]
        v = {t: sqrt(n) * table.get(t, other) for t, n in Counter(terms).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        found = [(-floor(sum(v.get(t, 0) * w for t, w in ws.items()) / norm * 10000 + 0.5) / 10000, name, not title) for (_, name, title), ws in templates.items()] if norm else []
        return min((f for f in found if -f[0] >= threshold), default=None)

    own, declared = [], {}
    for _, path, text in rows:
        t = text or ""
        blocks = [[]]
        for line in t.split("\n"):
            if any(c.isascii() and c.isalnum() for c in line):
                blocks[-1].append(line)
            elif blocks[-1]:
                blocks.append([])
        blocks = ["\n".join(b) for b in blocks]
        whole, first = best(t), best(blocks[0])
        lines = [b[:2] for b in map(best, t.split("\n") + blocks) if b]
        files = ([whole[:2]] if whole else []) + ([first[:2]] if first and not first[2] else [])
        own.append(min([(True, s, n) for s, n in lines] + [(False, s, n) for s, n in files], default=None))
        if files and path is not None:
            whole = min(files)
            folder = path.rpartition("/")[0]
            declared[folder] = min(declared.get(folder, whole), whole)
    out = []
    for (i, path, _), o in zip(rows, own):
        if o:
            out.append((i, path, o[2], -o[1], "header" if o[0] else "file", None))
            continue
        folder, got = path.rpartition("/")[0] if path is not None else None, None
        while folder is not None and not (got := declared.get(folder)):
            folder = folder.rpartition("/")[0] if folder else None
        out.append((i, path, got[1], -got[0], "inherited", folder) if got else (i, path, None, None, None, None))
    return sorted(map(str, out))


def test_headers_files_and_folders(spark):
    mit, gpl = "Released under the MIT License.", "Licensed under the GNU General Public License, version 3"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/x.c", prose(1, 50)), (3, "a/b/y.c", prose(2, 50) + "\n" + gpl + "\n" + prose(3, 9)), (4, "a/b/z.c", None),
        (5, "a/b/COPYING", gpl), (6, "a/b/c/d/e.c", "text"), (7, "other/f.c", ""), (8, None, prose(4, 9)), (9, None, mit), (10, "top", mit.upper()),
        (11, "ab/g.c", "licensed software"), (12, "a/x.c", prose(1, 50)), (13, "a/long", prose(5, 20_000) + "\n" + mit), (14, "a/NOTICE", "Licensed under CC BY-NC 4.0."),
        (15, "q/", "x"), (16, "", "y"), (17, "a/b/both", gpl + "\n" + mit),
    ]
    files = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, path string, text string, h string, folder string")
    assert sorted(map(str, map(tuple, licences.scan(files, "path", "text", "doc_id").collect()))) == brute(rows)


def test_anchors_lose_nothing():
    """Without its anchors, a template's weight is below the threshold."""
    anchors = set(licences.anchors())
    for k in range(len(licences.TEMPLATES)):
        assert sum(w * w for n, _, _, t, w, _ in licences.weights() if n == k and t not in anchors) < licences.THRESHOLD**2


def wrapped(text, before="", width=11):
    words = text.split()
    return "\n".join(before + " ".join(words[i : i + width]) for i in range(0, len(words), width))


def real_rows():
    texts = dict(TEXTS)
    gpl = "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n\n" + prose(6, 4000)
    gpl_notice = next(t for n, t, _ in licences.TEMPLATES if n == "GPL-3.0" and t.startswith("This program"))
    apache = next(t for n, t, _ in licences.TEMPLATES if n == "Apache-2.0" and t.endswith("obtain a copy of the License at"))
    mpl = next(t for n, t, _ in licences.TEMPLATES if n == "MPL-2.0" and t.startswith("This Source"))
    code = "\n */\n\n" + "int x = f(a, b);\n" * 50
    return [
        (1, "mit/LICENSE", "MIT License\r\n\r\nCopyright (c) 2020 A. Person\r\n\r\n" + wrapped(texts["MIT"])),
        (2, "mit/src/a.c", "int main() { return 0; }"),
        (3, "bsd/COPYING", "Copyright (c) 1999, 2000 The Authors. All rights reserved.\n\n" + wrapped(texts["BSD-3-Clause"])),
        (4, "bsd/deep/er/b.c", prose(7, 40)),
        (5, "bsd/deep/LICENSE", wrapped(texts["BSD-2-Clause"])),
        (6, "gpl/LICENSE", gpl),
        (7, "gpl/x/y.c", prose(8, 40)),
        (8, "gpl/x/own.c", "/*\n * A tool.\n *\n" + wrapped(apache, " * ") + "\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n" + code),
        (9, "gpl/x/head.c", "/*\n" + wrapped(gpl_notice, " * ") + "\n" + code),
        (10, "z/spdx.c", "// SPDX-License-Identifier: GPL-2.0-or-later\n" + code),
        (11, "z/mpl.c", wrapped(mpl, "# ") + "\n\n" + prose(9, 60)),
        (12, "z/free.c", "Notes\n\nMIT License is one of many, said the author.\n" + prose(9, 60)),
        (13, "isc/LICENSE", wrapped(texts["ISC"])),
        (14, "z/blank.c", "\n" * 20_000 + "a" + ".a" * 20_000 + "\n" * 20_000),
    ]


def test_real_licences_are_found_and_inherited(spark):
    rows = real_rows()
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path", "text", "doc_id").collect()
    assert sorted(map(str, map(tuple, got))) == brute(rows)
    assert {r.doc_id: (r.licence, r.via, r.declared_in) for r in got} == {
        1: ("MIT", "file", None), 2: ("MIT", "inherited", "mit"), 3: ("BSD-3-Clause", "file", None), 4: ("BSD-2-Clause", "inherited", "bsd/deep"),
        5: ("BSD-2-Clause", "file", None), 6: ("GPL-3.0", "file", None), 7: ("GPL-3.0", "inherited", "gpl"), 8: ("Apache-2.0", "header", None),
        9: ("GPL-3.0", "header", None), 10: ("GPL-2.0", "header", None), 11: ("MPL-2.0", "header", None), 12: (None, None, None),
        13: ("ISC", "file", None), 14: (None, None, None),
    }


def test_whole_texts_by_parameter(spark):
    long = prose(11, 3000)
    rows = [(1, "a/LICENSE", "Copyright 2001 Someone\n" + long), (2, "a/b/c", "x")]
    more = [*licences.TEMPLATES, ("House-1.0", long, False)]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), "path", "text", "doc_id", templates=more).collect()
    assert {(r.doc_id, r.licence, r.via) for r in got} == {(1, "House-1.0", "file"), (2, "House-1.0", "inherited")}


def test_sql_where_folders_declare(spark):
    """The provided documents hold no licence files; these do."""
    rows = [(i * 37, path.split("/")[0], text) for i, path, text in real_rows()]
    rows += [(i * 37 + 1, path.split("/")[0], prose(i, 20)) for i, path, _ in real_rows()] + [(9999, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = licences.scan(docs.withColumn("path", licences.path_of_document()), "path", "text", "doc_id").collect()
    with duckdb.connect() as con:
        con.register("documents", docs.toPandas())
        want = con.sql(licences.oracle()).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.via for r in got} == {"file", "header", "inherited", None}


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("path", licences.path_of_document())
    assert len(licences.scan(docs, "path", "text", "doc_id").collect()) == len(odd_rows())
    assert licences.scan(docs.limit(0), "path", "text", "doc_id").collect() == []
