"""URL filters: allow and block rules in a trie, of which the longest match decides.

A rule names a host and the start of a path, like ``example.com/en/``. It fits its host
and all subdomains, if the URL's path starts with the rule's. Of the rules that fit, the
one with most host labels decides, of those the one with the longest path; of an allow
and a block rule for the same place the block rule.

The trie goes along the host's labels from the last one on, then along the path's
segments. Of a rule's path the segment after its last slash may be a piece of one, so it
is kept as a tail of its node. A URL is walked once, label by label and segment by
segment, whatever the number of rules. The trie is broadcast; lists of rules may hold
``MOST_RULES`` rules of ``MOST_CHARS`` characters in all. Longer ones are joined: URLs,
each once, meet rules by node (``judged_by_join``), and nothing is broadcast.

Rules, by case: the host is what stands after the first ``://`` up to ``/``, ``?``, ``#``
or the end, A-Z in small letters, ports and names of users with it; the path goes on up to
``?``, ``#`` or the end; null and URLs without ``://`` have neither and get no rule but
one for the empty host; a URL that no rule fits gets the default, allow; no length is too
long; repeated rows are judged each; extra columns are kept, except that ``host``,
``path``, ``rule`` and ``verdict`` give way to the results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

ALLOW, BLOCK = "allow", "block"
#: The rules of the registered query: verdict, host and path. Fixed values.
RULES = [(ALLOW, "com/"), (BLOCK, "example.com/en/"), (ALLOW, "www.example.com/en/"), (BLOCK, "net/es/"), (BLOCK, "net/fr/")]
#: Rules and their characters that are broadcast, at most.
MOST_RULES, MOST_CHARS = 1_000_000, 64_000_000

RESULT = "host string, path string, rule string, verdict string"
CAPITALS = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [p for p in map(rest.find, "/?#") if p >= 0]
    cut = min(ends, default=len(rest))
    return rest[:cut].translate(CAPITALS), rest[cut:].partition("#")[0].partition("?")[0]


class Node:
    __slots__ = ("below", "path", "rules", "tails")

    def __init__(self):
        #: The nodes of longer hosts (in a host's node) or paths, by label or segment.
        self.below: dict[str, Node] = {}
        #: The path's first node, in a host's node.
        self.path: Node | None = None
        #: Rules by what they ask of the next segment's start, and their lengths, longest first.
        self.rules: dict[str, tuple[str, str]] = {}
        self.tails: list[int] = []


class Trie:
    """Rules, as pairs of a verdict and host and path."""

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root, self.size, self.chars = Node(), 0, 0
        self.listed = list(rules)
        for verdict, rule in self.listed:
            if verdict not in (ALLOW, BLOCK):
                raise ValueError(f"no verdict: {verdict!r}")
            self.size, self.chars = self.size + 1, self.chars + len(rule)
            if self.size > MOST_RULES or self.chars > MOST_CHARS:
                raise ValueError("too many rules to broadcast: judge by join")
            self._add(verdict, rule)

    def __reduce__(self):
        """A deep trie is no deep object to send: it is built again from its rules."""
        return Trie, (self.listed,)

    def _add(self, verdict: str, rule: str) -> None:
        host, slash, path = rule.partition("/")
        node = self.root
        for label in reversed(host.translate(CAPITALS).split(".")):
            node = node.below.setdefault(label, Node())
        node.path = node = node.path or Node()
        *whole, tail = (slash + path).split("/")
        for segment in whole:
            node = node.below.setdefault(segment, Node())
        if node.rules.get(tail, ("", ""))[0] != BLOCK:
            node.rules[tail] = (verdict, host.translate(CAPITALS) + slash + path)
        node.tails = sorted({len(t) for t in node.rules}, reverse=True)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest match, if any."""
        node, paths = self.root, []
        for label in reversed(host.split(".")):
            node = node.below.get(label)
            if node is None:
                break
            if node.path is not None:
                paths.append(node.path)
        segments = path.split("/") if paths else []
        return next((found for first in reversed(paths) if (found := self._along(first, segments))), None)

    @staticmethod
    def _along(node: Node, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for k, segment in enumerate(segments):
            best = next((node.rules[segment[:n]] for n in node.tails if len(segment) >= n and segment[:n] in node.rules), best)
            node = node.below.get(segment) if k + 1 < len(segments) else None
            if node is None:
                break
        return best


def judge(spark: SparkSession, trie: Trie, default: str = ALLOW):
    """A column function over URLs: host, path, rule and verdict."""
    sent = spark.sparkContext.broadcast(trie)

    @F.pandas_udf(RESULT)
    def judged_urls(urls: pd.Series) -> pd.DataFrame:
        trie, found = sent.value, []
        for url in urls:
            host, path = parts(url)
            verdict, rule = trie.match(host, path) or (default, None)
            found.append((host, path, rule, verdict))
        return pd.DataFrame(found, columns=["host", "path", "rule", "verdict"])

    return judged_urls


def _with_results(pages: DataFrame, results: Column) -> DataFrame:
    kept = [F.col(quoted(c)) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*kept, results.alias("_judged")).select(*[quoted(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")], "_judged.*")


def judged(pages: DataFrame, trie: Trie, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``pages`` with host, path, rule and verdict of their URL."""
    return _with_results(pages, judge(pages.sparkSession, trie, default)(F.col(quoted(url_col))))


def kept(pages: DataFrame, trie: Trie, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """The rows of ``pages`` that are allowed, as they are."""
    return pages.filter(judge(pages.sparkSession, trie, default)(F.col(quoted(url_col)))["verdict"] == ALLOW)


def host_of(url: Column) -> Column:
    """Built-in expressions for the host of ``parts``; only A-Z become small."""
    after = F.substring_index(F.substr(url, F.locate("://", url) + 3), "/", 1)
    host = F.regexp_extract(after, r"^[^?#]*", 0)
    capitals = "".join(map(chr, CAPITALS))
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.translate(host, capitals, capitals.lower())).otherwise("")


def path_of(url: Column) -> Column:
    after = F.substr(url, F.locate("://", url) + 3)
    return F.when(F.coalesce(F.contains(url, F.lit("://")), F.lit(False)), F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def judged_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """``judged`` for a table of rules (verdict, rule) of any size.

    Each URL, once, asks for the nodes on its way: the ends of its host with the starts
    of its path up to a slash. The rules of a node come by a shuffle join, their tails
    are compared, and the longest one stays.
    """
    capitals = "".join(map(chr, CAPITALS))
    slash = F.locate("/", F.col("rule"))
    host = F.translate(F.when(slash > 0, F.substr(F.col("rule"), F.lit(1), slash - 1)).otherwise(F.col("rule")), capitals, capitals.lower())
    path = F.when(slash > 0, F.substr(F.col("rule"), slash)).otherwise("")
    listed = rules.select("verdict", host.alias("r_host"), path.alias("r_path")).groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    listed = listed.select("*", F.regexp_extract("r_path", r"^(.*/)?", 0).alias("node"))
    url = F.coalesce(F.col(quoted(url_col)), F.lit(""))
    urls = pages.select(url.alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    # No rule is deeper than these, so longer hosts and paths give no more nodes.
    deepest = listed.agg(F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)), F.coalesce(F.max(F.size(F.split("node", "/"))), F.lit(1))).first()
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest[0]))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    starts = F.transform(F.sequence(F.lit(0), F.least(F.size(segments), F.lit(deepest[1])) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(segments, 1, k), "/"), F.lit("/"))))
    asked = urls.select("url", "path", F.explode(ends).alias("r_host"), starts.alias("nodes")).select("url", "path", "r_host", F.explode("nodes").alias("node"))
    fits = asked.join(listed.hint("shuffle_merge"), ["r_host", "node"]).filter(F.startswith("path", "r_path"))
    longest = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    best = fits.groupBy("url").agg(F.max(longest).alias("best")).select("url", "best.rule", "best.verdict")
    rows = pages.withColumn("_url", url).join(best.select(F.col("url").alias("_url"), F.struct("rule", "verdict").alias("_best")).hint("shuffle_merge"), "_url", "left")
    results = F.struct(host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    kept_columns = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return rows.select(*[quoted(c) for c in kept_columns], results.alias("_judged")).select(*[quoted(c) for c in kept_columns], "_judged.*")


ORACLE = """
WITH rules(verdict, r_host, r_path) AS (VALUES
  ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
after AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[position('://' IN url) + 3:] ELSE '' END AS a FROM pages),
cut AS (SELECT page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM after)
SELECT page_id, host, path,
  (SELECT r_host || r_path FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host) DESC, length(r_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) ORDER BY length(r_host) DESC, length(r_path) DESC LIMIT 1), 'allow') AS verdict
FROM cut
"""
