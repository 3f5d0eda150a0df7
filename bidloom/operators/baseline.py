"""Robust price baselines: exact quantiles, interquartile filter, reasonable low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.numbers import alert, deviation, rounded
from bidloom.sources.shared import saved

#: From so many prices on, tenths are interpolated; below, they are the extremes.
ENOUGH = 5
#: Buckets a doubling of the price is cut into.
FINENESS = 64


def valid(quotes: DataFrame, materials: DataFrame) -> DataFrame:
    """Quotes with a positive price, with what their material says."""
    m = materials.select(F.col("id").alias("material_id"), "category", "sub_category", "standard_name", "spec", "profession", "ref_price_reasonable_low", "ref_price_median")
    return quotes.filter("unit_price > 0").join(m, "material_id")


def with_tier(rows: DataFrame, tiers: DataFrame, by_category: bool = True) -> DataFrame:
    """A column ``tier``: the brand's in the row's category, else its generic one."""
    generic = tiers.filter("category IS NULL").groupBy(F.col("brand_name").alias("brand")).agg(F.min("tier").alias("_generic"))
    out = rows.join(generic, "brand", "left")
    if not by_category:
        return out.withColumnRenamed("_generic", "tier")
    special = tiers.filter("category IS NOT NULL").groupBy(F.col("brand_name").alias("brand"), "category").agg(F.min("tier").alias("_special"))
    return out.join(special, ["brand", "category"], "left").withColumn("tier", F.coalesce("_special", "_generic")).drop("_special", "_generic")


def counted(rows: DataFrame, keys: list[str], value: str = "unit_price") -> DataFrame:
    """How often each price occurs, by ``keys``: keys, v, c. Saved, so that all statistics read it and not the rows."""
    return saved(rows.groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c")))


def ranked(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (of ``keys`` or finer ones) with ``end``, the number of values up to this one in its group, and ``n``, that of all.

    Values are summed by bucket first, and ordered within a bucket only: a group with a
    third of all rows never meets in one task. Saved.
    """
    own = counts.groupBy(*keys, "v").agg(F.sum("c").alias("c")).withColumn("_b", F.floor(F.log2("v") * FINENESS))
    sizes = own.groupBy(*keys, "_b").agg(F.sum("c").alias("_size"))
    over = Window.partitionBy(*keys)
    start = F.sum("_size").over(over.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    sizes = sizes.select(*keys, "_b", start.alias("_start"), F.sum("_size").over(over).alias("n"))
    within = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return saved(own.join(sizes, [*keys, "_b"]).select(*keys, "v", "c", (F.sum("c").over(within) + F.col("_start")).alias("end"), "n"))


def value_at(place: Column) -> Column:
    """Aggregate of ranked rows: the value at a place counted from 0, in a straight line between neighbours."""
    at = lambda r: F.max(F.when((F.col("end") > r) & (F.col("end") - F.col("c") <= r), F.col("v")))
    low, share = F.floor(place), F.max(place - F.floor(place))
    return at(low) + (at(F.ceil(place)) - at(low)) * share


def quantiles(ranks: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``ranked`` values: keys, n, one column a probability."""
    return ranks.groupBy(*keys).agg(F.max("n").alias("n"), *[value_at((F.col("n") - 1) * p).alias(name) for name, p in probabilities.items()])


def fences(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """1.5 interquartile ranges beyond the quartiles: keys, n, iqr_lower, iqr_upper."""
    q = quantiles(ranks, keys, {"q1": 0.25, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return q.select(*keys, "n", (F.col("q1") - reach).alias("iqr_lower"), (F.col("q3") + reach).alias("iqr_upper"))


def fenced(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Ranked values with their group's fences, and ``inside``: whether they are within (bounds included)."""
    return ranks.join(fences(ranks, keys).drop("n"), keys).withColumn("inside", F.col("v").between(F.col("iqr_lower"), F.col("iqr_upper")))


def baseline(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of the prices in their fences, by ``keys``, from ``counted`` prices.

    keys, count (of all), filtered_count, mean, median, std (of a sample, 0 for one), cv,
    p10, p90, min, max, iqr_lower, iqr_upper, reasonable_low, historical_min (of all).
    """
    ranks = ranked(counts, keys)
    whole = saved(fenced(ranks, keys))
    inner, v, c = whole.filter("inside"), F.col("v"), F.col("c")
    stats = inner.groupBy(*keys).agg(
        F.max("n").alias("count"), F.sum("c").alias("filtered_count"), (F.sum(v * c) / F.sum("c")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"),
        F.max("iqr_lower").alias("iqr_lower"), F.max("iqr_upper").alias("iqr_upper"), F.min(F.col("end") - c).alias("_first"),
    )
    # The prices within the fences are neighbours in rank, so their quantiles are places from the first one on.
    place = lambda p: F.col("_first") + (F.col("filtered_count") - 1) * p
    spread = F.sum(c * (v - F.col("mean")) * (v - F.col("mean")))
    more = inner.join(stats.select(*keys, "mean", "filtered_count", "_first"), keys).groupBy(*keys).agg(
        spread.alias("_spread"), value_at(place(0.5)).alias("median"), value_at(place(0.1)).alias("q10"), value_at(place(0.9)).alias("q90")
    )
    lowest = whole.groupBy(*keys).agg(F.min("v").alias("historical_min"))
    many = F.col("filtered_count") >= ENOUGH
    std = F.when(F.col("filtered_count") > 1, F.sqrt(F.col("_spread") / (F.col("filtered_count") - 1))).otherwise(0.0)
    out = stats.join(more, keys).join(lowest, keys).withColumn("std", std)
    return out.select(
        *keys, "count", "filtered_count", "mean", "median", "std", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0).alias("cv"),
        F.when(many, F.col("q10")).otherwise(F.col("min")).alias("p10"), F.when(many, F.col("q90")).otherwise(F.col("max")).alias("p90"),
        "min", "max", "iqr_lower", "iqr_upper", F.col("min").alias("reasonable_low"), "historical_min",
    )


def lows(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The lowest and the mean price within the fences: keys, reasonable_low, mean."""
    return fenced(ranked(counts, keys), keys).filter("inside").groupBy(*keys).agg(F.min("v").alias("reasonable_low"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def variation(counts: DataFrame, keys: list[str]) -> DataFrame:
    """The coefficient of variation of the prices within the fences, of a sample: keys, cv (0 for one price)."""
    # Sums are taken from the lower fence on, so that their squares stay small.
    d, c, n = F.col("v") - F.col("iqr_lower"), F.col("c"), F.col("_n")
    sums = fenced(ranked(counts, keys), keys).filter("inside").groupBy(*keys).agg(F.sum("c").alias("_n"), F.sum(c * d).alias("_s"), F.sum(c * d * d).alias("_q"), F.max("iqr_lower").alias("_from"))
    mean, spread = F.col("_from") + F.col("_s") / n, F.greatest(F.col("_q") - F.col("_s") * F.col("_s") / n, F.lit(0.0))
    return sums.select(*keys, F.when((n > 1) & (mean > 0), F.sqrt(spread / (n - 1)) / mean).otherwise(0.0).alias("cv"))


def reasonable_low(rows: DataFrame, keys: list[str], projects: DataFrame) -> DataFrame:
    """The lowest price within the fences and where it comes from: keys, reasonable_low, quote_id, quote_date, project_name, historical_min."""
    ranks = ranked(counted(rows, keys), keys)
    inner = rows.join(fences(ranks, keys), keys).filter(F.col("unit_price").between(F.col("iqr_lower"), F.col("iqr_upper")))
    low = inner.groupBy(*keys).agg(F.min(F.struct("unit_price", "id", "quote_date", "project_id")).alias("_low"))
    names = projects.select(F.col("id").alias("_p"), F.col("name").alias("project_name"))
    lowest = ranks.groupBy(*keys).agg(F.min("v").alias("historical_min"))
    out = low.join(lowest, keys).join(names, F.col("_low.project_id") == F.col("_p"), "left")
    return out.select(*keys, F.col("_low.unit_price").alias("reasonable_low"), F.col("_low.id").alias("quote_id"), F.col("_low.quote_date").alias("quote_date"), "project_name", "historical_min")


def bounds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Columns yellow and red: the category's, else the default ones, else 0.05 and 0.10."""
    own = thresholds.select("category", F.col("yellow").alias("_y"), F.col("red").alias("_r"))
    default = thresholds.filter("category = 'default'").agg(F.coalesce(F.max("yellow"), F.lit(0.05)).alias("_dy"), F.coalesce(F.max("red"), F.lit(0.10)).alias("_dr"))
    # One row, so it may be joined to all.
    out = rows.join(own, "category", "left").crossJoin(F.broadcast(default))
    return out.withColumn("yellow", F.coalesce("_y", "_dy")).withColumn("red", F.coalesce("_r", "_dr")).drop("_y", "_r", "_dy", "_dr")


def compared(rows: DataFrame, thresholds: DataFrame, price: Column) -> DataFrame:
    """A new price against every category's baseline: category, reasonable_low, median, deviation_pct, alert_level."""
    base = bounds(baseline(counted(rows, ["category"]), ["category"]), thresholds)
    dev = rounded(deviation(price, F.col("reasonable_low")), 4)
    return base.select("category", "reasonable_low", "median", dev.alias("deviation_pct"), alert(dev, F.col("yellow"), F.col("red")).alias("alert_level"))


def refreshed(rows: DataFrame, floor: float = 0.05, factor: float = 1.5) -> DataFrame:
    """Reference prices of every material: groups are small, so each one's sorted prices do.

    Tenths are interpolated from five prices on, counted before the filter;
    supplier_count counts distinct brands.
    """

    def at(prices: Column, p: float) -> Column:
        place = (F.size(prices) - 1) * F.lit(p)
        low, high = (F.element_at(prices, (f(place) + 1).cast("int")) for f in (F.floor, F.ceil))
        return low + (high - low) * (place - F.floor(place))

    p = F.col("p")
    q = rows.groupBy("material_id").agg(F.array_sort(F.collect_list("unit_price")).alias("p"), F.array_sort(F.collect_set(F.when(F.col("brand") != "", F.col("brand")))).alias("recommended_brands"))
    q = q.withColumn("n", F.size("p")).withColumn("q1", at(p, 0.25)).withColumn("q3", at(p, 0.75)).withColumn("reach", 1.5 * (F.col("q3") - F.col("q1")))
    s = q.withColumn("p", F.filter("p", lambda x: x.between(F.col("q1") - F.col("reach"), F.col("q3") + F.col("reach"))))
    total = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + f(x))
    s = s.withColumn("avg", total(lambda x: x) / F.size("p"))
    s = s.withColumn("std", F.when(F.size("p") > 1, F.sqrt(total(lambda x: (x - F.col("avg")) * (x - F.col("avg"))) / (F.size("p") - 1))).otherwise(0.0))
    many, cv = F.col("n") >= ENOUGH, F.when(F.col("avg") > 0, F.col("std") / F.col("avg")).otherwise(0.0)
    low, high = F.element_at("p", 1), F.element_at("p", -1)
    return s.select(
        "material_id", low.alias("ref_price_reasonable_low"), F.when(many, at(p, 0.1)).otherwise(low).alias("ref_price_low"), F.col("avg").alias("ref_price_avg"),
        at(p, 0.5).alias("ref_price_median"), F.when(many, at(p, 0.9)).otherwise(high).alias("ref_price_high"), cv.alias("price_cv"),
        F.greatest(cv * factor, F.lit(floor)).alias("deviation_threshold"), "recommended_brands", F.size("recommended_brands").alias("supplier_count"),
    )
