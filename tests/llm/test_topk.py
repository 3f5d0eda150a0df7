import math
import random

import numpy as np

from bidloom.llm import topk

INF, NAN = float("inf"), float("nan")


def brute(rows, k=10, every=100):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in ok if i % every == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in ok if i != q and len(v) == len(a))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(230)]
    rows += [(300, None), (301, [0.1, None, 0, 0, 0, 0]), (302, [NAN] * 6), (400, [INF] * 6), (None, [1.0] * 6), (500, [0.5, 0.5]), (501, [0.5, -0.5])]
    rows += [(i, [0.9, 0.9, -0.3, 0.1, 0, 0]) for i in range(600, 760)]  # copies: ties
    rows += [(700, [0.9, 0.9, -0.3, 0.1, 0, 0]), (1000, [0.0] * 6), (1100, [])]
    rows = [(i, v and [x if x is None else float(x) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, id long")
    assert sorted(map(tuple, topk.of_table(df).collect())) == brute(rows)
    assert topk.of_table(df.limit(0)).collect() == []


def test_blocks_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v) for i, v in enumerate(rng.normal(0, 0.2, (1200, 16)).tolist())]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(vectors, vectors.filter("id % 100 = 0"), candidates=130)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_reading_stops_early():
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 100, (4000, 8))).astype(np.int64)
    rows[7] = 900
    lists = topk.Lists(rows)
    left = lists.best(np.full(8, 5), np.array([3]), 1)
    assert 7 in left and len(left) <= 4000 * topk.LEFT and lists.depth < 4000


def test_bounds_hold_at_any_size():
    """Small blocks are read like large ones; values near the limits of doubles lose no candidate."""
    rng = np.random.default_rng(4)
    for n, scale in [(11, 5), (40, 5), (300, 3), (300, 2**22), (300, 2**28)]:
        rows = rng.integers(-scale, scale + 1, (n, 12))
        lists = topk.Lists(rows)
        for _ in range(20):
            q = rng.integers(-scale, scale + 1, 12)
            scores = rows @ q
            top = np.lexsort((np.arange(n), -scores))[:10]
            assert set(top) <= set(lists.best(q, np.array([], int), 10))
            assert lists.depth > 0


def test_many_copies_of_a_row(spark):
    rows = [(1, [1.0, 1.0])] * 500 + [(2, [0.5, 1.0])] * 3 + [(100, [1.0, 0.5])] * 4 + [(i, [0.0, 0.1]) for i in range(3, 60)]
    vectors = topk.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = topk.search(vectors, vectors.filter("id % 100 = 0"), candidates=50)
    assert sorted(map(tuple, got.collect())) == brute(rows)
