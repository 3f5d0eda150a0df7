from collections import Counter
from math import log

import pytest
import xxhash

from bidloom.llm import lm_score

from .helpers import odd_docs, odd_rows, prose


def plain_words(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split(" ")


def brute(rows, chosen):
    """rows: (id, text); chosen: ids of the target. Losses by dictionaries, each document's own counts left out."""
    symbol = lambda w: xxhash.xxh64_intdigest(w.encode()) % lm_score.SYMBOLS
    split = [[symbol(w) for w in plain_words(t) if w] for _, t in rows]
    texts = [["<b>", *ws, "<b>"] if ws else [] for ws in split]
    models = []
    for of in ([t for t, (i, _) in zip(texts, rows) if i in chosen], texts):
        models.append((Counter(p for t in of for p in zip(t, t[1:])), Counter(s for t in of for s in t[1:])))
    sizes = [m[1].total() for m in models]
    scales = [1.0, sizes[0] / sizes[1] if all(sizes) else 1.0]
    out = []
    for (i, _), t in zip(rows, texts):
        own_pairs, own_single = Counter(zip(t, t[1:])), Counter(t[1:])
        mean = []
        for m, (pairs, single) in enumerate(models):
            own = m == 1 or i in chosen
            total = 0.0
            for a, b in zip(t, t[1:]):
                pair = (pairs[a, b] - own * own_pairs[a, b]) * scales[m]
                unigram = ((single[b] - own * own_single[b]) * scales[m] + lm_score.CELL) / (sizes[m] * scales[m] + lm_score.CELL * lm_score.ALL)
                total -= log((pair + lm_score.CONTEXT * unigram) / ((single[a] - own * own_single[a]) * scales[m] + lm_score.CONTEXT))
            mean.append(total / (len(t) - 1) if t else 0.0)
        out.append((i, max(0, len(t) - 2), *mean))
    return out


def corpus():
    rows = [(i, prose(i, 40 + i, "abc" if i % 3 else "xyz")) for i in range(60)] + [(60, None), (61, "  "), (62, "Abc, abc! ÀB"), (63, prose(1, 5000, "abcxyz"))]
    return rows + [(5, rows[5][1]), (6, "another text of six"), (None, "abc abc"), (None, "xyz")]


@pytest.mark.parametrize("hot", [lm_score.HOT, 40, 0])
def test_equals_brute_force(spark, monkeypatch, hot):
    """Whichever bigrams are common, and however many buckets there are."""
    monkeypatch.setattr(lm_score.common_bigrams, "__defaults__", (hot,))
    monkeypatch.setattr(lm_score, "BUCKET", 1000)
    monkeypatch.setattr(lm_score, "RUN", 3000)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 3)] + [(0, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    want = Counter((i, n, round(a, 6), round(b, 6)) for i, n, a, b in brute(rows, set(range(0, 60, 3))))
    got = lm_score.cross_entropy_difference(docs, labels).collect()
    assert Counter((r.doc_id, r.n_tokens, round(r.target_loss, 6), round(r.background_loss, 6)) for r in got) == want
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in got)
    mean = lambda rest: sum(r.score for r in got if r.doc_id is not None and r.doc_id < 60 and (r.doc_id % 3 == 0) == rest)
    assert mean(True) < mean(False)


def test_odd_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = lm_score.cross_entropy_difference(odd_docs(spark), labels).collect()
    assert len(got) == len(odd_rows())
    assert {tuple(r)[1:] for r in got if r.doc_id in (1, 2, 3)} == {(0, 0.0, 0.0, 0.0)}
    assert lm_score.cross_entropy_difference(odd_docs(spark).limit(0), labels).collect() == []
