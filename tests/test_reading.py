import json
import threading
import time

from bidloom.operators import extract as E

PAGE = "doc_id string, page int, content string"


def quote(*names):
    return json.dumps({"supplier_name": "S", "items": [{"material": n, "spec": "", "qty": "1", "unit_price": "2"} for n in names]})


def test_blocked_pages_are_read_by_halves(spark):
    def provider(text):
        if "secret" in text:
            raise E.Blocked("moderation")
        if "broken" in text:
            raise ValueError("no table")
        return quote(*text.split("\n")[:-1]), 0.9, 10, 5

    rows = [("d", 1, "a\nb\n"), ("d", 2, "c\nd\nsecret\ne\n"), ("d", 3, "broken\n"), ("d", 4, "x\na\n"), ("gone", 1, "secret\nsecret\n"), ("one", 1, "secret")]
    partials = E.pages_read(spark.createDataFrame(rows[::-1], PAGE), provider)
    got = sorted((r.doc_id, r.page, r.part, r.error is None) for r in partials.collect())
    assert got == [("d", 1, "", True), ("d", 2, "L", True), ("d", 2, "R", False), ("d", 3, "", False), ("d", 4, "", True), ("gone", 1, "L", False), ("gone", 1, "R", False), ("one", 1, "L", True), ("one", 1, "R", True)]
    deeper = E.pages_read(spark.createDataFrame(rows[1:2], PAGE), provider, cuts=2).collect()
    assert [(r.part, r.error) for r in deeper] == [("L", None), ("RL", "blocked: moderation"), ("RR", None)]
    docs = {r.doc_id: r for r in E.merged(partials).collect()}
    assert [i.material for i in docs["d"]["items"]] == ["a", "b", "c", "d", "x"]
    assert docs["d"].skipped == ["page2/R(blocked: moderation)", "page3(no table)"] and (docs["d"].status, docs["d"].pages, docs["d"].confidence) == ("done", 4, 0.9)
    assert docs["gone"].status == "failed" and len(docs["gone"].skipped) == 2


def test_at_most_six_pages_in_flight_and_in_order(spark):
    def provider(text):
        state = threading.__dict__.setdefault("_pages", {"now": 0, "lock": threading.Lock()})  # of the worker's process
        lock = state["lock"]
        with lock:
            state["now"] += 1
            now = state["now"]
        time.sleep(0.02 if int(text) % 3 else 0.08)
        with lock:
            state["now"] -= 1
        return quote(text), 1.0, now, 0

    pages = spark.createDataFrame([(f"d{k % 2}", k // 2, str(k)) for k in range(80)][::-1], PAGE).coalesce(1)
    rows = E.pages_read(pages.repartition(1), provider).collect()
    for d in ("d0", "d1"):
        assert [r.page for r in rows if r.doc_id == d] == list(range(40))
    assert max(r.tokens_used for r in rows) in (5, 6)


def test_repeats_of_long_documents_go(spark):
    """Thousands of items with few keys: the first of each stays, in order."""
    names = [f"m{k * 7 % 1000}" for k in range(6000)]
    data = [("d", n, quote(*names[n * 100 : n * 100 + 100]), 1.0, 1, 1) for n in range(60)]
    (row,) = E.merged(spark.createDataFrame(data, "doc_id string, page int, data string, confidence double, tokens_used long, duration_ms long")).collect()
    assert [i.material for i in row["items"]] == list(dict.fromkeys(names))
