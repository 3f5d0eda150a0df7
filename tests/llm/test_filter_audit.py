from collections import defaultdict
from itertools import permutations

import re

from bidloom.llm import filter_audit

from .helpers import odd_docs, odd_rows, prose, rows_of


def brute(rows, labels):
    """Every order run over every document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        parts[part or ""].append((fails, i in good, i in toxic))
    out = []
    for part, docs in parts.items():
        removed = defaultdict(int)
        steps = []
        for order in permutations("ABCDE"):
            left = docs
            for k, f in enumerate(order):
                here = [d for d in left if d[0][f]]
                left = [d for d in left if not d[0][f]]
                removed[f] += len(here)
                redundant = sum(d[0][f] for d in docs) - len(here)
                alone = sum(d[0][f] and sum(d[0].values()) == 1 for d in docs)
                steps.append((f, part, "".join(order), k + 1, len(left), len(here), redundant, alone, sum(d[1] for d in here), sum(d[2] for d in here)))
        out += [(*s[1:], removed[s[0]]) for s in steps]
    return sorted(out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_equals_every_order_run_over_every_document(spark):
    texts = [prose(1, 250), prose(2, 250, "ab"), prose(3, 250).upper(), prose(4, 220) + " 100 %", "one two\tthree", "", None, "A" * 300, "ÀÉ" * 90 + "ABC", " \n" * 5, "x " * 300, prose(1, 250)]
    rows = [(i, texts[i % len(texts)], (None, "", "en", "de")[i % 4]) for i in range(90)]
    rows += [(None, texts[0], "en"), (None, None, None), (3, texts[3], "en"), (0, texts[0], "fr"), (0, texts[0], "fr")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 60, 3)] + [(6, None, 1), (None, 1, 1), (9, 1, None), (999, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS good", "3 AS n", "4 AS spread", "5 AS digest", "6 AS `a.b`")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(filter_audit.report(docs, marks), *COLUMNS) == brute(rows, labels)


def test_odd_and_empty_tables(spark):
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = rows_of(filter_audit.report(odd_docs(spark), marks.limit(0)), *COLUMNS)
    assert got == brute([(r[0], r[1], r[2]) for r in odd_rows()], [])
    assert filter_audit.report(odd_docs(spark).limit(0), marks).collect() == []


def test_columns_by_name_with_dots(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x")], "`d.id` long, `the.text` string, `p.q` string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.report(docs, marks, "d.id", "the.text", "p.q").filter("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.part, r.removed, r.kept) for r in got] == [("x", 1, 1)]


def test_most_rows_one_text(spark):
    """A third of all rows and more share a text; cells stay 32 a part."""
    rows = [(i, "same" if i % 3 else f"text {i}", "en") for i in range(3000)]
    cells = filter_audit.cells(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert sorted((r.mask, r.n) for r in cells) == [(1, 1001), (17, 1999)]
