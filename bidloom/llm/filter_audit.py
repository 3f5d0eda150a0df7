"""How filters of a corpus interact: an audit of every order in which they may run.

Five filters look at whole texts. Built-in expressions turn each document into a mask
of five bits, one a filter it fails. All but the last bit tell from the text alone; the
last one (a copy of a document with a smaller id) comes from grouping the texts: a
group's smallest id passes. Documents are counted by part and mask, 32 cells a part, and
all orders of the filters are told from those cells: what a filter removes depends only
on the filters before it, so no document is looked at again.

Texts are grouped by their SHA-256 digest, so no text is shuffled, and what meets of a
group in one task is one row a part, quality and toxicity, however many copies it has.

Rules, by case: null text and null part count as empty; a text without words fails A
alone, and E if it is a copy; a text of any length is read whole; rows that share an id
count each, and rows of the smallest id all pass E; rows without an id are never copies
and make none; they have no labels; a document with several rows of labels is good or
toxic if any of them says so; extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted

FILTERS = "ABCDE"
#: What parts words.
BLANKS = r"[\x20\x09-\x0D]+"
#: Keys that rows without an id are spread over in the join with labels.
SPREAD = 1024


def failures(text: Column) -> list[Column]:
    """Of a text that is not null: whether it fails A, B, C and D."""
    words = F.array_remove(F.split(text, BLANKS), "")
    return [
        F.size(words) < 200,
        F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * F.lit(3).cast("long"),
        text.rlike("[#$%&*|]"),
    ]


def mask(fails: list[Column]) -> Column:
    """Failures as bits, the first one lowest."""
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents by part and mask: part, mask, n, good, toxic. At most 32 rows a part."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.coalesce(F.col(quoted(part_col)), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), mask(failures(F.col("text"))).alias("mask"))
    rows = rows.withColumn("spread", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest", F.monotonically_increasing_id()), F.lit(SPREAD))).otherwise(0))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]).withColumn("spread", F.lit(0))
    rows = rows.join(marks, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "mask", "good", "toxic"]
    # Rows of one id become one, so that a group's first id tells how many rows carry it.
    by_id = rows.groupBy("doc_id", "spread", *kind).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    smallest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("smallest"), F.col("first.n")).otherwise(0)
    told = by_text.withColumn("smallest", smallest).withColumn("passing", passing)
    copy = 1 << (len(FILTERS) - 1)
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    split = told.select("part", "good", "toxic", split.alias("x")).filter("x.n > 0").select("part", "good", "toxic", "x.*")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def steps() -> list[tuple[int, int, list[str]]]:
    """What a step does depends on its filter and on those before, in whatever order: the filter's bit, the others' bits, the orders that have such a step."""
    bit = {f: 1 << k for k, f in enumerate(FILTERS)}
    found: dict[tuple[int, int], list[str]] = {}
    for order in map("".join, permutations(FILTERS)):
        for k, f in enumerate(order):
            found.setdefault((bit[f], sum(bit[x] for x in order[:k])), []).append(order)
    return [(b, before, orders) for (b, before), orders in found.items()]


def audit(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step, from the parts' cells.

    part, filter_order, step; kept (after the step), removed (in it), redundant (fail its
    filter, went before), unique_fails (fail its filter alone), good_lost, toxic_lost
    (removed in it), shapley (what its filter removes, summed over all orders).
    """
    per_part = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    step = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(before).alias("before"), F.array(*map(F.lit, orders)).alias("orders")) for b, before, orders in steps()]))
    bit, before = F.col("s.bit"), F.col("s.before")
    fails, gone, alone = (lambda c: c["mask"].bitwiseAND(bit) != 0), (lambda c: c["mask"].bitwiseAND(before) != 0), (lambda c: c["mask"] == bit)
    stays = lambda c: c["mask"].bitwiseAND(bit.bitwiseOR(before)) == 0
    here = lambda c: fails(c) & ~gone(c)

    def total(where, what=lambda c: c["n"]) -> Column:
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + what(c))

    # Of j filters that a document fails, each comes first in one j-th of all orders and removes it there.
    orders = sum(1 for _ in permutations(FILTERS))
    share = lambda c: (c["n"] * orders / F.bit_count(c["mask"])).cast("long")
    told = per_part.select("part", "cells", step.alias("s")).select(
        "part",
        F.explode("s.orders").alias("filter_order"),
        (F.bit_count(before) + 1).alias("step"),
        total(stays).alias("kept"),
        total(here).alias("removed"),
        total(lambda c: fails(c) & gone(c)).alias("redundant"),
        total(alone).alias("unique_fails"),
        total(here, lambda c: c["good"]).alias("good_lost"),
        total(here, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )
    return told


def report(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    return audit(cells(docs, labels, id_col, text_col, part_col))


ORACLE = r"""
WITH firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
worded AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(w) < 200,
    'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t),
    'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(worded.doc_id > first, false)} AS f
  FROM worded JOIN firsts USING (t) LEFT JOIN marks ON marks.doc_id = worded.doc_id
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), kinds AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY ALL),
steps AS (
  SELECT part, array_to_string(o, '') AS filter_order, o[step] AS filter, step, n, good, toxic, f[o[step]] AS fails,
    len(list_filter(o[:step - 1], lambda x: f[x])) > 0 AS gone, len(list_filter(o, lambda x: f[x])) AS all_fails
  FROM kinds, orders, range(1, 6) s(step)
), told AS (
  SELECT part, filter_order, filter, step::INTEGER AS step,
    coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails AND all_fails = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL
)
SELECT * EXCLUDE (filter), (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM told
"""
