import random

from pyspark.sql import functions as F

from bidloom.operators import catalog, changes
from bidloom.sources import sinks

ROW = "id long, name string, wins long"
FEED = "seq long, op string, id long, name string, wins long"


def brute(table, feed, used):
    """One change after the other."""
    taken = {}
    for i, name, _ in table:
        taken.setdefault(name, set()).add(i)
    there, gone, first, rejects, made = {i: [n, w] for i, n, w in table}, set(), set(), [], []
    for seq, op, i, name, wins in sorted(feed):
        new = None if name is None else name.strip(" ")
        if op == "insert":
            reason = "blank" if not new else "duplicate" if new in taken or new in first else None
            if reason is None:
                first.add(new)
                made.append((new, wins))
        elif i not in there or i in gone:
            reason = "missing"
        elif op == "delete":
            reason = "referenced" if i in used else None
            gone |= {i} if reason is None else set()
        else:
            reason = "duplicate" if new in taken and taken[new] != {i} else None
            if reason is None:
                there[i] = [new or there[i][0], there[i][1] if wins is None else wins]
        if reason:
            rejects.append((seq, reason))
    top = max((i for i, _, _ in table), default=0)
    rows = [(i, *v) for i, v in there.items() if i not in gone] + [(top + k + 1, n, w) for k, (n, w) in enumerate(sorted(made))]
    return sorted(rows), sorted(rejects)


def test_feed_equals_one_change_after_the_other(spark):
    for seed in range(3):
        rng = random.Random(seed)
        names = [f"n{k}" for k in range(30)]
        table = [(i, names[i % 25], i) for i in range(40)]
        feed = []
        for seq in range(300):
            op = rng.choice(["insert", "update", "update", "delete"])
            feed.append((seq, op, None if op == "insert" else rng.randint(0, 45), rng.choice([None, "", "  ", *names, *(f" new{k} " for k in range(20))]), rng.choice([None, seq])))
        feed += [(1000 + k, "update", 7, None, k) for k in range(300)]  # one row has most of the feed
        used = set(range(0, 40, 3)) | {7}
        refs = spark.createDataFrame([(i,) for i in used for _ in range(3)] + [(None,)], "supplier_id long")
        out = changes.applied(spark.createDataFrame(table, ROW), spark.createDataFrame(feed, FEED), "name", ((refs, "supplier_id"),))
        rows, rejects = brute(table, feed, used)
        assert sorted(map(tuple, out.table.collect())) == rows
        assert sorted((r.seq, r.reason) for r in out.rejects.collect()) == rejects
        assert sum(r.n for r in out.counts.collect()) == len(feed)
        assert sum(r.n for r in out.counts.filter("outcome <> 'accepted'").collect()) == len(rejects)


def test_empty_feed_and_table(spark):
    table, feed = spark.createDataFrame([(1, "a", 1)], ROW), spark.createDataFrame([(1, "insert", None, "b", 2)], FEED)
    assert changes.applied(table, feed.limit(0)).table.collect() == table.collect()
    assert [tuple(r) for r in changes.applied(table.limit(0), feed).table.collect()] == [(1, "b", 2)]


def test_two_batches_with_equal_keys_in_either_order(spark, tmp_path):
    """The result does not depend on which batch was staged first; a batch may come twice."""
    a = spark.createDataFrame([(1, "x", "from a"), (2, "y", "from a")], "seq long, code string, value string")
    b = spark.createDataFrame([(1, "y", "from b"), (2, "z", "from b"), (3, "z", "again")], "seq long, code string, value string")
    got = []
    for order in (("a", "b"), ("b", "a", "a")):
        path = f"{tmp_path}/{''.join(order)}"
        for name in order:
            sinks.staged({"a": a, "b": b}[name], path, name)
        rows = changes.winners(spark.read.parquet(path), ["code"])
        got.append(sorted((r.code, r.value) for r in rows.collect()))
        sinks.swapped(rows, f"{path}-done")
        assert changes.winners(spark.read.parquet(path), ["code"], spark.read.parquet(f"{path}-done")).count() == 0
    assert got[0] == got[1] == [("x", "from a"), ("y", "from a"), ("z", "from b")]


def test_folder_is_swapped_whole_and_settled_after_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.swapped(spark.range(3), path)
    sinks.swapped(spark.read.parquet(path).unionByName(spark.range(10, 12)), path)  # reads what it takes the place of
    assert spark.read.parquet(path).count() == 5 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    spark.range(9).write.parquet(f"{path}.new")
    (tmp_path / "t").rename(tmp_path / "t.old")  # died between the renames
    sinks.settled(spark, path)
    assert spark.read.parquet(path).count() == 9 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    (tmp_path / "t").rename(tmp_path / "t.old")
    (tmp_path / "t.new").mkdir()  # half written
    sinks.settled(spark, path)
    assert spark.read.parquet(path).count() == 9 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]


def test_names_meet_at_their_rarest_pair(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("ab 公") for _ in range(rng.randint(1, 6)))
    detected, suppliers = [word() for _ in range(60)] + ["", "公司"], [(i, word()) for i in range(60)] + [(100, ""), (101, "某公司")]
    fold = lambda s: "".join(s.lower().split())
    want = {}
    for n in set(detected) - {""}:
        fits = [i for i, s in suppliers if s and (fold(n) == fold(s) or s in n or n in s)]
        if fits:
            want[n] = min(fits)
    got = catalog.matched_suppliers(spark.createDataFrame([(n,) for n in detected], "name string"), spark.createDataFrame(suppliers, "id long, name string"))
    assert {r.name: r.supplier_id for r in got.collect()} == want


def test_a_common_start_draws_no_pairs(spark):
    """Ten thousand names with one start: each is joined at its own rarest pair."""
    pool = spark.range(10_000).select("id", F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"))
    pairs = catalog._contained(pool.select(F.col("name").alias("i")).limit(500), pool.select(F.col("name").alias("o")))
    assert pairs.count() == 500


def test_upserts_take_the_last_of_equal_keys(spark):
    table = spark.createDataFrame([("a", None, 1)], "brand string, category string, tier long")
    rows = spark.createDataFrame([("a", None, 2, 5), ("a", None, 9, 3), ("b", "c", 7, 1)], "brand string, category string, tier long, at long")
    assert sorted(map(str, catalog.upserted(table, rows, ["brand", "category"], "at").collect())) == sorted(map(str, spark.createDataFrame([("a", None, 2), ("b", "c", 7)], table.schema).collect()))


def test_codes_of_a_prefix_that_has_most_rows(spark, monkeypatch):
    """Ranges cut through a prefix; numbers go on over them."""
    monkeypatch.setattr(catalog, "NAMES", 50)
    rows = spark.createDataFrame([("P" if k % 9 else "Q", k) for k in range(400)], "prefix string, k long")
    used = spark.createDataFrame([("Q-00007",), ("Q-99998",), ("x",)], "material_code string")
    got = {r.k: r.material_code for r in catalog.coded(rows, used, order=["k"]).collect()}
    p, q = [k for k in range(400) if k % 9], [k for k in range(400) if k % 9 == 0]
    assert got == {k: f"P-{n + 1:05d}" for n, k in enumerate(p)} | {k: f"Q-{n + 99999:05d}" for n, k in enumerate(q)}


def test_a_load_that_died_goes_on_with_the_same_numbers(spark, tmp_path):
    import shutil

    from bidloom.operators import bulk

    lines = [("a", n, [str(n), f"泵{n}", "W", "", "", "", "", "2", "", "10", "", f"b{n % 3}", ""]) for n in range(1, 8)] + [("b", n, ["x", "", "", ""]) for n in range(1)] + [("b", 1, ["1-1", "AL", "箱"]), ("b", 2, ["总计", "", "", "7"])]
    df = spark.createDataFrame(lines, "csv string, line_no int, cells array<string>")
    entries = spark.createDataFrame([("a", "汇总", "潜水泵", 7), ("b", "一期", "配电箱", 2)], "csv string, sheet string, category string, rows int")
    first = {t: sorted(map(str, f.collect())) for t, f in bulk.loaded(spark, df, entries, f"{tmp_path}/out").items()}
    assert {t: len(r) for t, r in first.items()} == {"projects": 1, "suppliers": 3, "materials": 8, "quotes": 8}
    for t in ("materials", "quotes"):
        shutil.rmtree(tmp_path / "out" / t)
    (tmp_path / "out" / "materials").mkdir()  # begun, not finished
    again = bulk.loaded(spark, df.orderBy(F.rand(3)), entries, f"{tmp_path}/out")
    assert {t: sorted(map(str, f.collect())) for t, f in again.items()} == first
    assert bulk.loaded(spark, df.limit(0), entries.limit(0), f"{tmp_path}/none")["quotes"].count() == 0
