import math
import random
import re
from collections import Counter

from bidloom.llm import tiered_search as ts

from .helpers import odd_docs, odd_rows, prose, rows_of


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in docs:
            n = sum(c.values())
            m = 25 + (75 * n * n_docs) // n_terms
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in Counter(terms(text)).items() if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3]))


def searched(spark, docs, items, **how):
    k = how.pop("k", 10)
    index = ts.build(spark.createDataFrame(docs, "doc_id long, text string"), **how)
    return ts.search(index, spark.createDataFrame(items, "item_id long, text string"), k)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(words[min(399, int(rng.paretovariate(0.7)) - 1)] for _ in range(rng.choice([3, 30, 300])))
    return [(i, text()) for i in range(n)]


def test_equals_brute_force_by_any_cut(spark):
    docs = corpus(1, 300) + [(7, "w1 W2, w3"), (7, "w1 W2, w3"), (None, "w1 w2 w3"), (900, None), (901, ""), (902, "... --"), (903, "w390 " * 5000), (904, "Überfall 日本 ÄÖ w9")]
    docs += [(i, "w390 w391 w392") for i in range(1000, 1100)]  # ties
    rng = random.Random(2)
    items = [(i, " ".join(f"w{rng.randint(0, 399)}" for _ in range(rng.randint(1, 30)))) for i in range(30)] + [(50, None), (51, "none such"), (52, "W390 w391"), (52, "W390 w391"), (None, "日本 überfall Überfall"), (53, "w1 w1 w1 w2")]
    want = brute(docs, items)
    seen = set()
    for how in ({}, {"run_size": 500, "cuts": (0.5, 0.2, 0.05)}, {"run_size": 3000, "cuts": ()}):
        got = searched(spark, docs, items, **how)
        seen |= {(len(how), r.tier) for r in got.select("tier").distinct().collect()}
        assert rows_of(got, "item_id", "rank", "doc_id", "score") == want, how
    assert len({t for _, t in seen}) > 1  # some items are proven in a higher tier


def test_high_tiers_prove_items_of_rare_words(spark):
    """Documents of one length: all postings of rare words are in the first tier, those of a common one below it."""
    docs = [(i, f"common {'x' * (i % 40 + 1)} {'y' * (i % 40 + 1)}") for i in range(400)]
    got = searched(spark, docs, [(1, "xxx yyy"), (2, "common xxx")], cuts=(0.3,)).collect()
    assert {(r.item_id, r.tier) for r in got} == {(1, 1), (2, 2)} or {(r.item_id, r.tier) for r in got} == {(1, 1), (2, 1)}
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got) == brute(docs, [(1, "xxx yyy"), (2, "common xxx")])


def test_batches_agree(spark):
    docs, items = corpus(3, 120), [(i, f"w{i} w{i + 1} w{3 * i}") for i in range(40)]
    index = ts.build(spark.createDataFrame(docs, "doc_id long, text string"), run_size=2000)
    got = ts.search(index, spark.createDataFrame(items, "item_id long, text string"), 3, batch=30)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute(docs, items, 3)
    index.delete()


def test_odd_and_empty_tables(spark):
    odd = odd_docs(spark).selectExpr("*", "1 AS run", "2 AS term", "3 AS `a.b`")
    items = [(1, prose(1, 20)), (2, "one two 123"), (3, "")]
    rows = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS q")
    assert rows_of(ts.search(ts.build(odd), rows), "item_id", "rank", "doc_id", "score") == brute([(r[0], r[1]) for r in odd_rows()], items)
    assert ts.search(ts.build(odd.limit(0)), rows).collect() == []
    assert ts.search(ts.build(odd), rows.limit(0)).collect() == []
