import random
import re
from collections import Counter

import numpy as np
import xxhash

from bidloom.llm import simhash
from bidloom.llm.components import components

from .helpers import odd_docs, odd_rows, prose, rows_of


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(shingles))


def plain_components(rows, radius=4):
    """rows: (id, fingerprint). The smallest id of everything reachable."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in set(group)}
    return [ids[g] for g in group]


def test_odd_rows_equal_brute_force(spark):
    want_fp = [plain_fingerprint(r[1]) for r in odd_rows()]
    want = sorted(zip([r[0] for r in odd_rows()], [f"{f:016x}" for f in want_fp], plain_components([(r[0], f) for r, f in zip(odd_rows(), want_fp)])), key=str)
    got = sorted(map(tuple, simhash.linked(odd_docs(spark)).collect()), key=str)
    assert got == want
    assert simhash.linked(odd_docs(spark).limit(0)).collect() == []


def test_links_reach_all_pairs_also_in_crowded_buckets(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(8):
            fps.add(base)
            for _ in range(rng.randint(1, 5)):
                base ^= 1 << rng.randrange(64)
    dense = rng.getrandbits(64)  # a dense group: many fingerprints within a few bits of one
    for _ in range(150):
        fps.add(dense ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = plain_components([(i, f) for i, f in enumerate(fps)])
    for most in (simhash.MOST, 20_000):  # the smaller one cuts buckets again
        pairs = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), most=most)
        root = {x: x for x in signed} | {r.node: r.root for r in components(pairs).collect()}
        groups, wanted = {}, {}
        for i, x in enumerate(signed):
            groups.setdefault(root[x], set()).add(i)
            wanted.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (0, 1)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_keeps_columns(spark):
    docs = spark.createDataFrame([(5, prose(9, 400), 1), (3, prose(9, 400), 2), (8, prose(11, 300), 3), (None, "alone", 4)], "doc_id long, text string, component_id long")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert rows_of(got, "doc_id", "component_id") == [(None, 4), (3, 2), (8, 3)]
