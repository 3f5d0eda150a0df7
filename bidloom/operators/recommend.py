"""Supplier recommendation: history with decay, price, overall and brand scores, then fill-up with newcomers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.numbers import percent, rounded
from bidloom.sources.shared import saved

from .scoring import scored, share, tallied

FOLD_DAYS = 180.0
UNDATED = 0.3
#: Up to so many suppliers, quotes weigh by their age; beyond, they are counted.
DECAYED_UP_TO = 60
COLD_START = 50


def decay(day: Column, now: str) -> Column:
    age = F.datediff(F.lit(now).cast("date"), day.try_cast("date"))
    return F.when(age.isNull(), UNDATED).otherwise(F.exp(-F.greatest(age, F.lit(0)) / FOLD_DAYS))  # greatest() skips nulls


def history(valid: DataFrame, categories: list[str], now: str) -> DataFrame:
    """supplier_id, history_count, avg_deviation, dev_count, recent_history."""
    rows = valid.filter(F.col("category").isin(categories)) if categories else valid
    ref = F.coalesce("ref_price_reasonable_low", "ref_price_median")
    dev = F.when(ref > 0, (F.col("unit_price") - ref) / ref)
    dev = F.coalesce("deviation_pct", dev) if "deviation_pct" in rows.columns else dev
    out = rows.groupBy("supplier_id").agg(F.count("*").alias("history_count"), F.avg(dev).alias("avg_deviation"), F.count(dev).alias("dev_count"), F.sum(decay(F.col("quote_date"), now)).alias("decayed"))
    return _recent(out)


def _recent(out: DataFrame) -> DataFrame:
    """``out`` with recent_history in the place of decayed."""
    few = out.agg((F.count("*") <= DECAYED_UP_TO).alias("few"))  # one row
    return out.crossJoin(F.broadcast(few)).withColumn("recent_history", F.when(F.col("few"), F.col("decayed")).otherwise(F.col("history_count").cast("double"))).drop("few", "decayed")


def per_category(valid: DataFrame, categories: list[str], top: int = 3) -> DataFrame:
    """supplier_id, breakdown: the ``top`` categories with counts, as text."""
    counts = valid.filter(F.col("category").isin(categories)).groupBy("supplier_id", "category").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("supplier_id").orderBy(F.desc("n"), "category"))).filter(F.col("r") <= top)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("r", "category", "n"))), lambda x: F.concat_ws(" ", x.category, x.n))
    return ranked.groupBy("supplier_id").agg(F.array_join(parts, " · ").alias("breakdown"))


def brands_of(valid: DataFrame, first: int = 10) -> DataFrame:
    return valid.filter("brand <> ''").groupBy("supplier_id").agg(F.slice(F.array_sort(F.collect_set("brand")), 1, first).alias("brands"))


def _history_of(tally: DataFrame, categories: list[str]) -> DataFrame:
    """``history`` from the counts of ``tallied``."""
    rows = tally.filter(F.col("category").isin(categories)) if categories else tally
    out = rows.groupBy("supplier_id").agg(F.sum("deals").alias("history_count"), share(F.sum("told"), F.sum("tolds")).alias("avg_deviation"), F.sum("tolds").alias("dev_count"), F.sum("weights").alias("decayed"))
    return _recent(out.filter("history_count > 0"))


def assessed(suppliers: DataFrame, tally: DataFrame, tiers: DataFrame, categories: list[str], required: list[str] | None = None, scope: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All suppliers with their score over ``categories`` (over all quotes, if there are none) and its parts.

    ``tally`` has the counts of ``tallied`` by these categories; scores are read from
    those in ``scope`` alone. The overall score follows the first
    category; a brand that is required twice counts twice.
    """
    past = _history_of(tally, categories)
    tally = scope(tally)
    known = scored(suppliers, tally, tiers, category=categories[0] if categories else None)
    known = known.join(past, "supplier_id", "left")
    x = F.greatest(F.lit(-0.10), F.least(F.lit(0.20), F.col("avg_deviation")))
    by_history = F.least(F.lit(100.0), F.log1p(F.coalesce("recent_history", F.lit(0.0))) * 24.0)
    by_price = F.when(F.col("avg_deviation").isNull(), 50.0).otherwise((0.20 - x) / 0.30 * 100.0)
    bonus = F.lit(0.0)
    if required:
        of = tally.filter(F.col("category").isin(categories)) if categories else tally
        brands = of.filter("quoted > 0").filter(F.col("brand").isin(required)).groupBy("supplier_id").agg(F.collect_set("brand").alias("brands"))
        known = known.join(brands, "supplier_id", "left")
        hits = sum((F.when(F.array_contains("brands", b), 1).otherwise(0) for b in required), F.lit(0))
        bonus = hits / F.lit(len(required)) * 20.0
    total = 0.30 * by_history + 0.25 * by_price + 0.25 * F.col("total_score") + 0.20 * F.col("brand_score") + bonus
    return known.select(
        "supplier_id", "supplier_name", rounded(total, 1).alias("score"), F.coalesce("history_count", F.lit(0)).alias("history_count"), rounded(by_history, 1).alias("history_score"),
        rounded(F.col("avg_deviation"), 4).alias("avg_deviation_pct"), F.coalesce("dev_count", F.lit(0)).alias("dev_count"), rounded(by_price, 1).alias("price_score"),
        F.col("total_score").alias("overall_score"), "brand_score", F.col("history_count").isNotNull().alias("_past"),
    )


def recommend(suppliers: DataFrame, quotes: DataFrame, valid: DataFrame | None, tiers: DataFrame, categories: list[str], n: int, now: str, required: list[str] | None = None) -> DataFrame:
    """The ``n`` best suppliers with history in ``categories``, filled up from the first others, which are scored over all categories: rank, supplier_id, score and its parts.

    ``quotes`` and ``valid`` are as for ``score``; they are read once, and all scores come from their counts.
    Without a category nobody has history in it, and the list is filled up alone; n of 0 or less gives none.
    """
    n = max(n, 0)
    tally = saved(tallied(quotes, valid, categories, decay(F.col("quote_date"), now)))
    best = assessed(suppliers, tally, tiers, categories, required).filter("_past" if categories else "false").orderBy(F.desc("score"), "supplier_id").limit(n)
    best = saved(best)  # n rows
    others = suppliers.join(F.broadcast(best.select(F.col("supplier_id").alias("id"))), "id", "left_anti").orderBy("id").limit(COLD_START)
    few = F.broadcast(others.select(F.col("id").alias("supplier_id")))
    mine = lambda df: df.join(few, "supplier_id", "left_semi")
    fresh = assessed(others, tally, tiers, [], required, mine).withColumn("_past", F.lit(False)).orderBy(F.desc("score"), "supplier_id").limit(n)
    # At most 2 n rows.
    order = Window.orderBy(F.desc("_past"), F.desc("score"), "supplier_id")
    return best.unionByName(fresh).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("_past")


def summaries(recommended: DataFrame, valid: DataFrame, categories: list[str]) -> DataFrame:
    """``recommended`` (a page of suppliers) with ``summary``: deals by category, mean deviation, overall score, as text."""
    out = recommended = saved(recommended)
    deals = F.concat(F.lit("历史成交 "), F.col("history_count"), F.lit(" 次"))
    if categories:
        own = valid.join(F.broadcast(recommended.select("supplier_id")), "supplier_id", "left_semi")
        out = out.join(per_category(own, categories), "supplier_id", "left")
        deals = F.coalesce(F.concat(F.lit("成交 "), F.col("history_count"), F.lit(" 次（"), F.col("breakdown"), F.lit("）")), F.concat(F.lit(f"在 {len(categories)} 个品类成交 "), F.col("history_count"), F.lit(" 次")))
    covered = F.when(F.col("dev_count") < F.col("history_count"), F.format_string(" (%d/%d 条有偏差数据)", "dev_count", "history_count")).otherwise("")
    dev = F.when(F.col("avg_deviation_pct").isNotNull(), F.concat(F.lit("平均偏差 "), percent(F.col("avg_deviation_pct")), covered))
    parts = F.array_compact(F.array(deals, dev, F.concat(F.lit("综合评分 "), F.bround("overall_score", 0).cast("long"))))
    return out.withColumn("summary", F.array_join(parts, " · ")).drop("breakdown")


def preselected(recommended: DataFrame, first: int = 3) -> DataFrame:
    """``recommended`` with ``chosen``: the first ones are ticked at the start."""
    return recommended.withColumn("chosen", F.col("rank") <= first)
