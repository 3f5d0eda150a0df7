"""Supplier scores in five weighted dimensions, all suppliers in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.constants import SCORE_WEIGHTS
from bidloom.functions.numbers import rounded


def price_score(dev: Column) -> Column:
    """By mean deviation from the reference, in straight pieces; 60 without one."""
    return (
        F.when(dev.isNull(), 60.0).when(dev <= -0.10, 100.0).when(dev <= 0, 80.0 + (0.10 + dev) / 0.10 * 20.0)
        .when(dev <= 0.10, 60.0 + (0.10 - dev) / 0.10 * 20.0).when(dev <= 0.20, 40.0 + (0.20 - dev) / 0.10 * 20.0).otherwise(F.greatest(F.lit(20.0), 40.0 - (dev - 0.20) * 100))
    )


def history_score(wins: Column) -> Column:
    return F.when(wins >= 5, 100.0).when(wins >= 3, 80.0).when(wins >= 1, 60.0).otherwise(40.0)


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Defaults for missing keys; the sum may miss 1 by a hundredth."""
    out = SCORE_WEIGHTS | (weights or {})
    if abs(sum(out.values()) - 1) > 0.01 + 1e-9:
        raise ValueError(f"weights sum to {sum(out.values())}, not 1")
    return out


def checked_thresholds(bounds: dict[str, tuple[float, float]]) -> dict[str, tuple[float, float]]:
    """Alert bounds whose yellow is below their red."""
    for category, (yellow, red) in bounds.items():
        if yellow >= red:
            raise ValueError(f"{category}: yellow ({yellow}) is not below red ({red})")
    return bounds


def config_value(config: DataFrame, key: str, default: str | None = None) -> str | None:
    """The value (JSON text) of a key of ``config`` (key, value), else the default."""
    found = config.filter(F.col("key") == key).select("value").first()
    return found[0] if found else default


def completeness(quotes: DataFrame) -> DataFrame:
    """supplier_id, share: quotes with a positive price among all, whatever their category."""
    return quotes.groupBy("supplier_id").agg((F.count_if(F.col("unit_price") > 0) / F.count("*")).alias("share"))


def tallied(quotes: DataFrame, valid: DataFrame | None = None, categories: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """The quotes in one pass, counted by supplier_id, brand and category (null for all that are not in ``categories``).

    quoted, priced (with a positive price), deals (rows of ``valid``), dev and devs (sum and
    number of the deals' deviations from their reference), told and tolds (the same, with the
    deviation that a row states before that), weights (sum of ``weight`` over the deals).
    ``valid`` may be left out if ``quotes`` have their material's reference prices.
    """
    price, refs = F.col("unit_price"), ["ref_price_reasonable_low", "ref_price_median"]
    kind = ["category"] if categories else []
    rows, quoted, deal = quotes, F.lit(True), price > 0
    if valid is not None:
        stated = [c for c in ("deviation_pct", "quote_date") if c in valid.columns]
        one = quotes.select("supplier_id", *kind, "brand", "unit_price", F.lit(True).alias("_quoted"))
        rows = one.unionByName(valid.select("supplier_id", *kind, "unit_price", *refs, *stated, F.lit(False).alias("_quoted")), allowMissingColumns=True)
        quoted, deal = F.col("_quoted"), ~F.col("_quoted")
    ref = F.coalesce(*refs)
    dev = F.when(ref > 0, (price - ref) / ref)
    told = F.coalesce("deviation_pct", dev) if "deviation_pct" in rows.columns else dev
    own = lambda c: F.when(deal, c)
    among = [F.when(F.col(c).isin(categories), F.col(c)).alias(c) for c in kind]
    out = rows.groupBy("supplier_id", "brand", *among).agg(
        F.count_if(quoted).alias("quoted"), F.count_if(quoted & (price > 0)).alias("priced"), F.count_if(deal).alias("deals"), F.sum(own(dev)).alias("dev"), F.count(own(dev)).alias("devs"),
        F.sum(own(told)).alias("told"), F.count(own(told)).alias("tolds"), *([F.sum(own(weight)).alias("weights")] if weight is not None else []),
    )
    return out if kind else out.withColumn("category", F.lit(None).cast("string"))


def share(part: Column, of: Column) -> Column:
    """A quotient; none of nothing."""
    return part / F.nullif(of, F.lit(0))


def score(suppliers: DataFrame, quotes: DataFrame, valid: DataFrame | None, tiers: DataFrame, weights: dict[str, float] | None = None, category: str | None = None) -> DataFrame:
    """supplier_id, supplier_name, five scores and total_score.

    ``valid`` has quotes with a positive price and their material's reference prices
    (the reasonable low; the median where that is null); if ``quotes`` have these prices it
    may be None, and the quotes are read once. Brands are those of all
    ``quotes``, priced or not, which need a ``category`` where one is given; their hit
    rate is rounded to a tenth before it is weighted. Completeness ignores the category.
    """
    return scored(suppliers, tallied(quotes, valid, [category] if category else None), tiers, weights, category)


def scored(suppliers: DataFrame, tally: DataFrame, tiers: DataFrame, weights: dict[str, float] | None = None, category: str | None = None) -> DataFrame:
    """``score`` from the counts of ``tallied``."""
    w = checked_weights(weights)
    own = (lambda c: F.when(F.col("category") == category, F.col(c))) if category else F.col
    named = tiers.select(F.col("brand_name").alias("brand")).distinct().withColumn("hit", F.lit(1))
    brands = tally.groupBy("supplier_id", "brand").agg(F.sum("quoted").alias("quoted"), F.sum("priced").alias("priced"), F.sum(own("quoted")).alias("own"), F.sum(own("dev")).alias("dev"), F.sum(own("devs")).alias("devs"))
    branded = (F.col("brand") != "") & (F.col("own") > 0)
    found = brands.join(named, "brand", "left").groupBy("supplier_id").agg(
        share(F.sum("dev"), F.sum("devs")).alias("dev"), (share(F.sum("priced"), F.sum("quoted")) * 100).alias("complete"),
        rounded(share(F.count_if(branded & F.col("hit").isNotNull()), F.count_if(branded)) * 100, 1).alias("brand"),
    )
    out = suppliers.withColumnRenamed("id", "supplier_id").join(found, "supplier_id", "left")
    parts = {
        "price": price_score(F.col("dev")), "history": history_score(F.col("win_count")), "completeness": F.least(F.lit(100.0), F.coalesce("complete", F.lit(50.0))),
        "brand": F.coalesce("brand", F.lit(70.0)), "commercial": F.when(F.col("cooperation_score") > 0, F.col("cooperation_score").cast("double")).otherwise(60.0),
    }
    total = sum((x * weight for x, weight in zip(parts.values(), w.values(), strict=True)), F.lit(0.0))
    return out.select("supplier_id", F.col("name").alias("supplier_name"), *[rounded(x, 1).alias(f"{k}_score") for k, x in parts.items()], rounded(total, 1).alias("total_score"))


def compare(ids: list[int], suppliers: DataFrame, quotes: DataFrame, valid: DataFrame, tiers: DataFrame, category: str, project_id: int | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The named suppliers in one category, in the order given (unknown ones left out): position, supplier_id, supplier_name, avg_price, quote_count, completeness, total_score."""
    asked = F.array(*[F.lit(i).cast("long") for i in ids])
    mine = lambda df: df.filter(F.col("supplier_id").isin(ids))
    of = mine(valid).filter(F.col("category") == category)
    of = of.filter(F.col("project_id") == project_id) if project_id else of
    prices = of.groupBy("supplier_id").agg(F.avg("unit_price").alias("avg_price"), F.count("*").alias("quote_count"))
    out = score(suppliers.filter(F.col("id").isin(ids)), mine(quotes), mine(valid), tiers, weights, category)
    out = out.join(prices, "supplier_id", "left").join(completeness(mine(quotes)), "supplier_id", "left")
    return out.select(
        F.array_position(asked, F.col("supplier_id")).alias("position"), "supplier_id", "supplier_name", "avg_price", F.coalesce("quote_count", F.lit(0)).alias("quote_count"),
        rounded(F.coalesce("share", F.lit(0.0)), 3).alias("completeness"), "total_score",
    )
