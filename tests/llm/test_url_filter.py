import random

import pytest

from bidloom.llm import url_filter
from bidloom.llm.url_filter import ALLOW, BLOCK, RULES, Trie


def plain(url, rules, default=ALLOW):
    """Every rule tried, without a trie."""
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:].split("#")[0].split("?")[0]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        h, p = h.lower(), slash + p
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            found = (h.count("."), len(p), verdict == BLOCK, h + p, verdict)
            best = max(best or found, found)
    return host, path, best and best[3], best[4] if best else default


ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.COM/en/1", "http://example.com", "http://example.com?x", "http://example.com/en", "http://example.com/en/", "http://example.com/en/a/../b?c#d", "http://a.b.c.net/es/", "http://net/fr/x"]
ODD += ["http://com/", "http://.com/x", "http://com./x", "http://xcom/", "http://u:p@example.com:80/en/x", "http://example.com#/en/x", "x://y://example.net/fr/", "http://ÄÉ.net/fr/ü", "http://example.com/\nen/", "http://net/es", "http://net//es/", "http://a..net/es/q", "https://www.example.com/en/x", "http://m.www.example.com/en/x", "http://" + "a." * 5000 + "net/fr/" + "s/" * 5000]


def test_given_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD + ODD)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS `a.b`")
    want = [(i, 1, *plain(u, RULES)) for i, u in rows]
    got = url_filter.judged(pages, Trie(RULES))
    assert got.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    assert sorted(map(tuple, got.drop("url").collect())) == want
    assert url_filter.judged(pages.limit(0), Trie(RULES)).collect() == []
    kept = url_filter.kept(pages, Trie(RULES))
    assert kept.columns == pages.columns and sorted(r.page_id for r in kept.collect()) == [w[0] for w in want if w[-1] == ALLOW]


def random_case(seed):
    rng = random.Random(seed)
    label, segment = lambda: rng.choice(["a", "b", "com", ""]), lambda: rng.choice(["x", "xy", "y", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 3)))
    path = lambda: "".join("/" + segment() for _ in range(rng.randint(0, 3)))
    rules = [(rng.choice([ALLOW, BLOCK]), host() + path()) for _ in range(rng.randint(0, 25))]
    return rules, ["http://" + host().upper() + path() + rng.choice(["", "?q", "#f"]) for _ in range(60)] + [None, "none"]


@pytest.mark.parametrize("seed", range(40))
def test_trie_equals_all_rules_tried(seed):
    rules, urls = random_case(seed)
    trie = Trie(rules)
    for u in urls:
        host, path = url_filter.parts(u)
        verdict, rule = trie.match(host, path) or (ALLOW, None)
        assert (host, path, rule, verdict) == plain(u, rules), (u, rules)


@pytest.mark.parametrize("seed", range(3))
def test_join_equals_trie(spark, seed):
    """Rules beyond the broadcast's bound; one host has most of the URLs."""
    rules, urls = random_case(seed + 100)
    rows = [(i, u) for i, u in enumerate(urls + ODD + [urls[0]] * 100)]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'x' AS verdict")
    listed = spark.createDataFrame(rules + RULES, "verdict string, rule string")
    got = url_filter.judged_by_join(pages, listed, default=BLOCK)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    want = [(i, *plain(u, rules + RULES, BLOCK)) for i, u in rows]
    assert sorted(map(tuple, got.drop("url").collect())) == want


def test_bounds_and_verdicts(monkeypatch):
    monkeypatch.setattr(url_filter, "MOST_RULES", 2)
    with pytest.raises(ValueError, match="join"):
        Trie(RULES)
    with pytest.raises(ValueError, match="verdict"):
        Trie([("maybe", "com/")])
    assert Trie([(ALLOW, "a.b/c"), (BLOCK, "A.b/c")]).match("a.b", "/cd") == (BLOCK, "a.b/c")
