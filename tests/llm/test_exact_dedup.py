from collections import defaultdict
from hashlib import sha256

from bidloom.llm import exact_dedup

from .helpers import odd_docs, odd_rows, rows_of


def test_groups_equal_brute_force(spark):
    groups = defaultdict(list)
    for r in odd_rows():
        groups[r[1] or ""].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, sha256(t.encode()).hexdigest()) for i in ids]
    assert rows_of(exact_dedup.groups(odd_docs(spark))) == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))
    assert exact_dedup.groups(odd_docs(spark).limit(0)).collect() == []


def test_deduplicated_keeps_one_row_of_each_text(spark):
    docs = odd_docs(spark)
    got = exact_dedup.deduplicated(docs)
    assert got.schema == docs.schema or got.columns == docs.columns
    best = {}
    for r in odd_rows():
        t = r[1] or ""
        best[t] = max(best.get(t, (-1,)), (-1 if r[0] is None else r[0],))
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got.collect()) == sorted((t, i) for t, (i,) in best.items())
    small = {r.doc_id for r in exact_dedup.deduplicated(docs, keep="smallest").collect()}
    assert 6 in small and 7 not in small


def test_maps_and_dotted_names_come_back(spark):
    rows = [(i, ["a", "b"][i % 2], {"k": str(i)}, i) for i in range(6)] + [(7, None, None, 7), (8, "", {}, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `m.x` map<string,string>, `a.b` int")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted((r[0], r[1], r[2], r[3]) for r in got.collect()) == [(4, "a", {"k": "4"}, 4), (5, "b", {"k": "5"}, 5), (8, "", {}, 8)]


def test_a_group_with_a_third_of_all_rows(spark):
    """Joined by broadcast, the rest by a shuffle, with the same result."""
    rows = [(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    got = exact_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = defaultdict(list)
    for i, t in rows:
        sizes[t].append(i)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, max(sizes[t]), len(sizes[t])) for i, t in rows} and len(got) == 600
