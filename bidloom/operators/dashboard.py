"""Dashboards and statistics: one pass a group instead of a query a category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.constants import LOST
from bidloom.functions.numbers import rounded
from bidloom.functions.text import clean_brand, date_key, dates_in, sub_category

from .baseline import ENOUGH, counted, quantiles, ranked, variation, with_tier

UNKNOWN_SUPPLIER = "未知供应商"
UNNAMED = "未分类"


def totals(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias(name))
        out = n if out is None else out.crossJoin(n)
    return out


def summary(materials: DataFrame, quotes: DataFrame) -> DataFrame:
    """By category: profession, materials, quotes, avg_price (of positive ones), price_cv (within the fences), suppliers, projects."""
    m = materials.groupBy("category").agg(F.count("*").alias("materials"), F.min("profession").alias("profession"))
    price = F.when(F.col("unit_price") > 0, F.col("unit_price"))
    rows = quotes.join(materials.select(F.col("id").alias("material_id"), "category"), "material_id")
    q = rows.groupBy("category").agg(F.count("*").alias("quotes"), F.avg(price).alias("avg_price"), F.countDistinct("supplier_id").alias("suppliers"), F.countDistinct("project_id").alias("projects"))
    cv = variation(counted(rows.filter("unit_price > 0"), ["category"]), ["category"]).select("category", F.col("cv").alias("price_cv"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    profession = F.coalesce("profession", F.lit(UNNAMED)).alias("profession")
    return m.join(q, "category", "left").join(cv, "category", "left").select("category", profession, "materials", zero("quotes"), "avg_price", "price_cv", zero("suppliers"), zero("projects"))


def price_statistics(rows: DataFrame, keys: list[str], sample: bool, factor: float = 1.5, floor: float = 0.05) -> DataFrame:
    """By ``keys``: count, mean, median, std (of a sample or of the population), cv, min, max, p10, p90 (the extremes below five prices), suggested_threshold."""
    counts = counted(rows, keys)
    ranks = ranked(counts, keys)
    v, c = F.col("v"), F.col("c")
    s = ranks.groupBy(*keys).agg(F.max("n").alias("count"), (F.sum(v * c) / F.max("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    spread = ranks.join(s.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("spread"))
    q = quantiles(ranks, keys, {"q10": 0.1, "median": 0.5, "q90": 0.9}).drop("n")
    std = F.when(F.col("count") > 1, F.sqrt(F.col("spread") / (F.col("count") - 1 if sample else F.col("count")))).otherwise(0.0)
    out = s.join(spread, keys).join(q, keys).withColumn("std", std).withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(0.0))
    many = F.col("count") >= ENOUGH
    return out.select(
        *keys, "count", "mean", "median", "std", "cv", "min", "max", F.when(many, F.col("q10")).otherwise(F.col("min")).alias("p10"), F.when(many, F.col("q90")).otherwise(F.col("max")).alias("p90"),
        F.greatest(F.col("cv") * factor, F.lit(floor)).alias("suggested_threshold"),
    )


def sub_category_statistics(valid: DataFrame) -> DataFrame:
    """By category and sub-category (blank ones under one label), deviation of the population."""
    rows = valid.withColumn("sub_category", F.when(F.trim("sub_category") != "", F.col("sub_category")).otherwise(UNNAMED))
    return price_statistics(rows, ["category", "sub_category"], sample=False)


def category_detail(valid: DataFrame, materials: DataFrame, category: str) -> DataFrame:
    """Sub-categories of one category, the commonest first, with the category's materials and valid prices beside them."""
    mine = materials.filter(F.col("category") == category)
    total = F.broadcast(mine.agg(F.count("*").alias("total_records")))  # one row
    own = sub_category_statistics(valid.filter(F.col("category") == category)).crossJoin(total)
    return own.withColumn("valid_prices", F.sum("count").over(Window.partitionBy("category"))).orderBy(F.desc("count"), "sub_category")


def file_statistics(rows: DataFrame) -> DataFrame:
    """Rows of category files (category, name, price, brand, remark) by category: totals, share of missing prices, brands, sub-category counts, dates in remarks."""
    rows = rows.withColumn("sub", sub_category(F.col("name"), F.col("category")))
    whole = rows.groupBy("category").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("price") > 0).alias("n_valid_price"), F.array_sort(F.collect_set(clean_brand(F.trim("brand")))).alias("brands"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(dates_in(F.col("remark"))))), lambda x, y: F.when(date_key(x) < date_key(y), -1).when(date_key(x) > date_key(y), 1).otherwise(0)).alias("dates"),
    )
    subs = rows.groupBy("category", "sub").agg(F.count("*").alias("n")).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "sub", "n"))), lambda x: F.concat_ws(" ", x["sub"], x["n"])).alias("sub_categories"))
    missing = rounded((F.col("n_total") - F.col("n_valid_price")) / F.greatest("n_total", F.lit(1)) * 100, 1)
    return whole.withColumn("price_missing_pct", missing).withColumn("n_brands", F.size("brands")).join(subs, "category")


def file_analysis(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """``file_statistics`` with ``n_projects`` from the manifest and ``price_stats``: by sub-category, most prices first.

    Each has sub_category, count, mean, median, std, cv, min, max, p10, p90 (the extremes
    below five prices) and suggested_threshold: one and a half times the cv, five hundredths at least.
    """
    from bidloom.sources.files import project_counts

    priced = rows.filter("price > 0").select("category", sub_category(F.col("name"), F.col("category")).alias("sub_category"), F.col("price").cast("double").alias("unit_price"))
    s = price_statistics(priced, ["category", "sub_category"], sample=True)
    s = s.withColumns({c: rounded(F.col(c), 2) for c in ("mean", "median", "std", "min", "max", "p10", "p90")}).withColumn("cv", rounded(F.col("cv"), 3))
    s = s.withColumn("suggested_threshold", rounded(F.greatest(F.col("cv") * 1.5, F.lit(0.05)), 3))
    one = F.struct((-F.col("count")).alias("m"), *[c for c in s.columns if c != "category"])
    stats = s.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("m")).alias("price_stats"))
    return file_statistics(rows).join(stats, "category", "left").join(project_counts(entries), "category", "left").fillna(0, ["n_projects"])


def dated(rows: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows of a period; dates are strings, so an empty one fails a lower bound."""
    if date_from:
        rows = rows.filter(F.col("quote_date") >= date_from)
    return rows.filter(F.col("quote_date") <= date_to) if date_to else rows


def amount() -> Column:
    return F.col("unit_price") * F.coalesce("quantity", F.lit(1.0))


def treemap(valid: DataFrame, projects: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """project, category, value; quotes without a project and lost bids are left out."""
    rows = dated(valid.filter(F.col("bid_status") != LOST), date_from, date_to)
    sums = rows.filter("project_id IS NOT NULL").groupBy("project_id", "category").agg(F.sum(amount()).alias("value"))
    return sums.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project")), "project_id").select("project", "category", "value")


def nested(rows: DataFrame, parent: str, child: str, value: str = "value") -> DataFrame:
    """parent, value (of all its children), children: array of (value, child), the largest first."""
    kids = F.sort_array(F.collect_list(F.struct(F.col(value).alias("value"), F.col(child).alias("name"))), asc=False)
    return rows.groupBy(parent).agg(F.sum(value).alias("value"), kids.alias("children"))


def bubbles(valid: DataFrame, suppliers: DataFrame, tiers: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """category, supplier, value, brand (the commonest; of equally common ones the first by name), tier (the brand's)."""
    rows = dated(valid.filter(F.col("bid_status") != LOST), date_from, date_to)
    keys = ["category", "supplier_id"]
    # One shuffle of the rows: sums by brand first, from which the sums and the commonest brand follow.
    by_brand = rows.groupBy(*keys, F.coalesce("brand", F.lit("")).alias("brand")).agg(F.count("*").alias("n"), F.sum(amount()).alias("value"))
    top = F.min(F.when(F.col("brand") != "", F.struct((-F.col("n")).alias("n"), "brand")))
    sums = by_brand.groupBy(*keys).agg(F.sum("value").alias("value"), top.brand.alias("brand"))
    named = sums.join(suppliers.select(F.col("id").alias("supplier_id"), F.col("name")), "supplier_id", "left")
    return with_tier(named, tiers).select("category", F.coalesce("name", F.lit(UNKNOWN_SUPPLIER)).alias("supplier"), "value", "brand", "tier")


def bubbles_nested(rows: DataFrame) -> DataFrame:
    """``bubbles`` as one row a category: total_amount, children (amount, name, tier), the largest first."""
    kids = F.sort_array(F.collect_list(F.struct(F.col("value").alias("amount"), F.col("supplier").alias("name"), "tier")), asc=False)
    return rows.filter("value <> 0").groupBy("category").agg(F.sum("value").alias("total_amount"), kids.alias("children")).orderBy(F.desc("total_amount"), "category")


def quote_statistics(quotes: DataFrame) -> DataFrame:
    """count, avg, min and max of positive prices."""
    p = quotes.filter("unit_price > 0")
    return p.agg(F.count("*").alias("count"), F.avg("unit_price").alias("avg"), F.min("unit_price").alias("min"), F.max("unit_price").alias("max"))


def alert_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.count_if(F.col("alert_level") == level).alias(level) for level in ("normal", "yellow", "red")])


def batches(quotes: DataFrame, suppliers: DataFrame, projects: DataFrame) -> DataFrame:
    """By batch, the newest first: quotes, first created, the supplier and the project with the largest id."""
    ids = quotes.filter(F.col("batch_id").isNotNull() & (F.col("batch_id").cast("string") != "")).groupBy("batch_id")
    of = ids.agg(F.count("*").alias("quotes"), F.min("created").alias("created"), F.max("supplier_id").alias("supplier_id"), F.max("project_id").alias("project_id"))
    s, p = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier")), projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    named = of.join(s, "supplier_id", "left").join(p, "project_id", "left")
    return named.select("batch_id", "quotes", "created", F.coalesce("supplier", F.lit("")).alias("supplier"), F.coalesce("project", F.lit("")).alias("project")).orderBy(F.desc("created"), "batch_id")


def supplier_cards(suppliers: DataFrame, year: str) -> DataFrame:
    """total, ai_score_high (85 or more), new_this_year (last cooperation in it), high_frequency (5 wins or more)."""
    return suppliers.agg(
        F.count("*").alias("total"), F.count_if(F.col("ai_score") >= 85).alias("ai_score_high"), F.count_if(F.col("last_cooperation").startswith(year)).alias("new_this_year"),
        F.count_if(F.col("win_count") >= 5).alias("high_frequency"),
    )


def category_tree(materials: DataFrame) -> DataFrame:
    """Counts by profession and category, by profession, and of all (nulls mark the sums)."""
    return materials.rollup("profession", "category").agg(F.count("*").alias("materials"), F.grouping_id().cast("int").alias("level"))


def dashboard_cards(base: DataFrame, materials: DataFrame) -> DataFrame:
    """scattered (categories with cv over 1), professions, categories."""
    return base.agg(F.count_if(F.col("cv") > 1).alias("scattered")).crossJoin(materials.agg(F.countDistinct("profession").alias("professions"), F.countDistinct("category").alias("categories")))


def export_statistics(materials: DataFrame, quotes: DataFrame) -> DataFrame:
    """By category, unquoted materials kept: quotes, suppliers."""
    q = quotes.select("material_id", "supplier_id", F.lit(1).alias("one"))
    return materials.select(F.col("id").alias("material_id"), "category").join(q, "material_id", "left").groupBy("category").agg(F.count("one").alias("quotes"), F.countDistinct("supplier_id").alias("suppliers"))


def price_trend(valid: DataFrame) -> DataFrame:
    """Mean price by category and month; undated quotes are left out."""
    return valid.filter("quote_date <> ''").groupBy("category", F.substring("quote_date", 1, 7).alias("month")).agg(F.count("*").alias("quotes"), F.avg("unit_price").alias("avg_price"))


def sufficiency(stats: DataFrame) -> DataFrame:
    """Whether a category's data carries a comparison of bids.

    ``stats``: category, n_projects, n_brands, n_valid_price, price_missing_pct. Points
    are given for projects, brands, valid prices and few gaps; then a verdict, and for
    each of three rounds whether it can be held.
    """
    projects, brands, prices, gaps = (F.col(c) for c in ("n_projects", "n_brands", "n_valid_price", "price_missing_pct"))
    step = lambda x, *levels: F.coalesce(*[F.when(x >= least, value) for least, value in levels])
    points = {
        "projects": step(projects, (5, 3), (3, 2), (0, 1)), "brands": step(brands, (3, 3), (2, 2), (1, 1), (0, 0)), "prices": step(prices, (100, 3), (30, 2), (0, 1)),
        "gaps": F.when(gaps < 5, 2).when(gaps < 20, 1).otherwise(0),
    }
    score = sum(points.values(), F.lit(0))
    verdict = F.when(brands == 0, "⚠️ 勉强支撑（无品牌数据）").when(F.col("score") >= 9, "✅ 可支撑比价").when(F.col("score") >= 6, "⚠️ 勉强支撑").otherwise("❌ 不足以支撑")
    count = lambda text, n, end: F.concat(F.lit(f"{text}("), n, F.lit(f"{end})"))
    notes = [
        F.when(projects >= 5, count("项目覆盖充足", projects, "个")).when(projects >= 3, count("项目覆盖一般", projects, "个")).otherwise(count("项目覆盖不足", projects, "个，建议≥3")),
        F.when(brands >= 3, count("供应商多样性好", brands, "家")).when(brands >= 2, count("供应商偏少", brands, "家")).when(brands == 1, "仅单一供应商，无法横向比价").otherwise("无供应商/品牌数据，无法比价"),
        F.when(prices >= 100, count("有效价格数据充足", prices, "条")).when(prices >= 30, count("有效价格数据一般", prices, "条")).otherwise(count("有效价格数据偏少", prices, "条")),
        F.when(gaps >= 20, F.concat(F.lit("价格缺失率高("), gaps, F.lit("%)"))).when(gaps >= 5, F.concat(F.lit("价格缺失率"), gaps, F.lit("%"))),
    ]
    mark = lambda good, fair: F.when(good, "✅").when(fair, "⚠️").otherwise("❌")
    return stats.withColumn("score", score).select(
        "category", "n_projects", "n_brands", "n_valid_price", "price_missing_pct", "score", verdict.alias("verdict"), F.array_compact(F.array(*notes)).alias("notes"),
        mark(prices >= 30, prices >= 10).alias("round1"), mark(brands >= 3, brands >= 2).alias("round2"), mark((brands >= 3) & (projects >= 3), brands >= 2).alias("round3"),
    )


def top_suppliers(quotes: DataFrame, n: int = 3) -> DataFrame:
    return quotes.groupBy("supplier_id").agg(F.count("*").alias("quotes")).orderBy(F.desc("quotes"), "supplier_id").limit(n)


def latest(rows: DataFrame, keys: list[str], order: str = "id") -> DataFrame:
    """The row of each key with the largest ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(order, *rest), order).alias("_r"))
    return best.select(*keys, "_r.*")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*rows.columns)
