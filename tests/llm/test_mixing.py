from collections import Counter, defaultdict
from math import log

from bidloom.llm import mixing

from .helpers import odd_docs, odd_rows, prose


def entropy(shares):
    return -sum(p * log(p) for p in shares)


def corpus(spark):
    rows = [(i, prose(i, 10 + i % 50), "big" if i % 3 else f"s{i % 7}") for i in range(900)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_weights_and_budgets(spark):
    rows, docs = corpus(spark)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len(t.split()) + 1
    total = sum(tokens.values())
    plan = mixing.Plan(docs, "doc_id", "text", "source", 0.9, 4.0)
    a = plan.temperature.exponent
    powers = {s: (n / total) ** a for s, n in tokens.items()}
    weights = {s: p / sum(powers.values()) for s, p in powers.items()}
    assert 0 < a < 1 and abs(entropy(weights.values()) / log(len(tokens)) - 0.9) < 1e-5
    budget = max(tokens[s] / weights[s] for s in tokens)
    got = mixing.schedule(docs, block_tokens=2000).collect()
    used, seen = Counter(), defaultdict(set)
    for r in got:
        used[r.source] += r.n_tokens
        seen[r.doc_id].add(getattr(r, "pass"))
        assert abs(r.weight - weights[r.source]) < 1e-9
    longest = max(len(t.split()) + 1 for _, t, _ in rows)
    assert all(weights[s] * budget - longest - 1 <= used[s] <= weights[s] * budget + 1 for s in tokens)
    assert len(seen) == len(rows) and all(p == set(range(len(p))) for p in seen.values())
    # A block holds every source by its weight, in a shuffled order.
    blocks = defaultdict(Counter)
    for r in got:
        blocks[r.block][r.source] += r.n_tokens
    assert len(blocks) == -(-int(budget) // 2000) and all(abs(b["big"] / b.total() - weights["big"]) < 0.1 for b in blocks.values())
    assert all(sorted(r.place for r in got if r.block == b) == list(range(1, 1 + sum(r.block == b for r in got))) for b in blocks)


def test_passes_are_heads_of_one_order(spark):
    """The partial pass is the head of its order, cut at the budget: re-taken from the turns by plain sums."""
    rows, docs = corpus(spark)
    plan = mixing.Plan(docs, "doc_id", "text", "source", 0.9, 4.0)
    for s in plan.sources.collect():
        turns = plan.rows.filter(plan.rows.s == s.s).select("doc_id", "w", mixing.turn(mixing.F.lit(s.passes), mixing.F.col("doc_id"), mixing.F.col("w")).alias("turn")).collect()
        left, want = s.rest, set()
        for r in sorted(turns, key=lambda r: (r.turn, r.doc_id)):
            if r.w > left:
                break
            left -= r.w
            want.add(r.doc_id)
        got = {r.doc_id for r in plan.ordered().filter((mixing.F.col("s") == s.s) & (mixing.F.col("pass") == s.passes)).collect()}
        assert got == want


def test_repetition_limit_wins(spark):
    _, docs = corpus(spark)
    plan = mixing.Plan(docs, "doc_id", "text", "source", 0.999, 1.5)
    assert max(r.budget / r.tokens for r in plan.sources.collect()) <= 1.5 + 0.01


def test_mixed_realises_the_schedule(spark):
    """Rows come by whole blocks, in the schedule's order within each."""
    _, docs = corpus(spark)
    plan = sorted(mixing.schedule(docs, block_tokens=2000).collect(), key=lambda r: (r.block, r.place))
    want = defaultdict(list)
    for r in plan:
        want[r.block].append(r.doc_id)
    got = [r.doc_id for r in mixing.mixed(docs, block_tokens=2000).collect()]
    assert len(want) > 5 and len(got) == len(plan)
    starts = {tuple(ids): None for ids in want.values()}
    at = 0
    while at < len(got):
        block = next(b for b in starts if list(b) == got[at : at + len(b)])
        del starts[block]
        at += len(block)
    assert not starts


def test_mixed_keeps_columns_of_any_name(spark):
    names = ["_key", "_s", "_passes", "_last", "_copy", "s", "w", "row", "block", "turn", "a.b", "pass", "key"]
    docs = corpus(spark)[1].limit(30)
    for n in names:
        docs = docs.withColumn(n, mixing.F.lit(n))
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and got.count() >= 30
    assert all([r[k] for k in range(3, 3 + len(names))] == names for r in got.collect())


def test_mixed_repeats_as_scheduled(spark):
    for docs in (corpus(spark)[1], odd_docs(spark)):
        want = Counter(r.doc_id for r in mixing.schedule(docs).collect())
        got = mixing.mixed(docs)
        assert got.columns == docs.columns
        assert Counter(r.doc_id for r in got.select("doc_id").collect()) == want
    assert set(want) == {r[0] for r in odd_rows()}
    assert mixing.mixed(docs.limit(0)).collect() == [] and mixing.schedule(docs.limit(0)).collect() == []


def test_buckets_and_runs_make_no_difference(spark, monkeypatch):
    docs = corpus(spark)[1].limit(200)
    whole = sorted(map(tuple, mixing.schedule(docs, block_tokens=2000).collect()))
    monkeypatch.setattr(mixing, "BUCKET_TOKENS", 100)
    monkeypatch.setattr(mixing, "RUN", 3)
    assert sorted(map(tuple, mixing.schedule(docs, block_tokens=2000).collect())) == whole
