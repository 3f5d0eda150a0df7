"""The bid matrix: materials by suppliers with baseline, deviation, alert and recommendation.

Its form is long, one row a material and supplier asked for; ``wide`` and ``nested``
give the other forms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.constants import JOINT_VENTURE
from bidloom.functions.numbers import alert, deviation, percent, rounded
from bidloom.sources.shared import saved

from .baseline import bounds, counted, lows
from .dashboard import latest


def letter(position: Column) -> Column:
    """A.. by position from 1; numbers after 26."""
    return F.when(position <= 26, F.char(64 + position)).otherwise(position.cast("string"))


def only_joint_venture(offers: DataFrame) -> DataFrame:
    """One row, ``jv``: whether all stated tiers of these quotes are joint-venture ones (and there is one)."""
    return offers.agg((F.array_compact(F.collect_set(F.nullif("tier", F.lit("")))) == F.array(F.lit(JOINT_VENTURE))).alias("jv"))


def aligned_offers(groups: DataFrame, items: DataFrame, offers: DataFrame) -> DataFrame:
    """The prices of confirmed groups: group_id, supplier_id, id, unit_price, quantity (of the supplier's last item), name, spec, and the reference material's columns.

    ``offers``: quotes with a positive price. The reference material is that of the
    supplier of a group's first item.
    """
    of = items.filter("action = 'align'").select("group_id", "supplier_id", F.col("id").alias("item"), F.col("quote_id").alias("id"))
    of = of.join(offers.select("id", "unit_price", "quantity", "material_id", "category", "sub_category"), "id")
    one = of.groupBy("group_id", "supplier_id").agg(F.min("item").alias("first"), F.max_by(F.struct("id", "unit_price", "quantity", "material_id", "category", "sub_category"), "item").alias("q"))
    lead = one.groupBy("group_id").agg(F.min_by(F.struct("q.material_id", "q.category", "q.sub_category"), "first").alias("m"))
    named = groups.select(F.col("id").alias("group_id"), F.col("suggested_name").alias("name"), F.col("suggested_spec").alias("spec"))
    return one.join(lead, "group_id").join(named, "group_id").select("group_id", "supplier_id", "q.id", "q.unit_price", "q.quantity", "name", "spec", "m.*")


def matrix(
    valid: DataFrame, suppliers: DataFrame, thresholds: DataFrame, supplier_ids: list[int], project_id: int | None = None, category: str | None = None, material_ids: list[int] | None = None,
    groups: DataFrame | None = None, items: DataFrame | None = None, quotes: DataFrame | None = None,
) -> DataFrame:
    """One row a row of the matrix and supplier asked for.

    group_id (of an aligned row), material_id, material, spec, supplier_id, label, name,
    price, total, reference, deviation_pct, alert_level, is_lowest, min_deviation,
    recommended, historical_avg, period, projects, tier_filter.

    ``valid``: quotes with a positive price, their tier and their material's columns;
    ``quotes``: all quotes with their category, from which the period and the number of
    projects of a category come (``valid``, if not given). Every supplier asked for has a
    cell, unknown ones too (without a label); rows without any price drop out. A lone
    supplier that only offers joint-venture brands is measured by prices of that tier.
    With a project and a category, confirmed alignment groups make rows of their own, and
    their quotes leave the materials' rows, with no other quote in their place.
    """
    spark = valid.sparkSession
    valid = valid if "tier" in valid.columns else valid.withColumn("tier", F.lit(None).cast("string"))
    asked = spark.createDataFrame([(i, k + 1) for k, i in enumerate(dict.fromkeys(supplier_ids))], "supplier_id long, position int")  # a request's list
    offers = valid.filter(F.col("supplier_id").isin(supplier_ids))
    for name, value in (("project_id", project_id), ("category", category)):
        offers = offers.filter(F.col(name) == value) if value else offers
    lone = only_joint_venture(offers) if len(set(supplier_ids)) == 1 and category else spark.createDataFrame([(False,)], "jv boolean")
    lone = F.broadcast(lone.select(F.coalesce("jv", F.lit(False)).alias("jv")))  # one row
    if material_ids:
        offers = offers.filter(F.col("material_id").isin(material_ids))
    last = latest(offers.select("material_id", "supplier_id", "id", "unit_price", "quantity", "category", "sub_category", "standard_name", "spec"), ["material_id", "supplier_id"])
    last = last.select(F.lit(None).cast("long").alias("group_id"), "material_id", "supplier_id", "unit_price", "quantity", "category", "sub_category", F.col("standard_name").alias("material"), F.coalesce(F.col("spec").cast("string"), F.lit("")).alias("spec"), "id")
    if groups is not None and items is not None and project_id and category:
        live = groups.filter((F.col("project_id") == project_id) & (F.col("category") == category) & (F.col("status") == "confirmed"))
        inside = items.join(live.select(F.col("id").alias("group_id")), "group_id", "left_semi")
        last = last.join(inside.filter("action = 'align'").select(F.col("quote_id").alias("id")), "id", "left_anti")
        rows = aligned_offers(live, inside, valid)
        last = last.unionByName(rows.select("group_id", "material_id", "supplier_id", "unit_price", "quantity", "category", "sub_category", F.col("name").alias("material"), "spec", "id"))
    last = saved(last)
    row = ["group_id", "material_id", "category", "sub_category", "material", "spec"]
    own = ["group_id", "material_id"]
    grid = last.select(*row).distinct().crossJoin(F.broadcast(asked)).alias("g")
    cells = grid.join(last.select(*own, "supplier_id", "unit_price", "quantity").alias("l"), F.expr("g.group_id <=> l.group_id AND g.material_id = l.material_id AND g.supplier_id = l.supplier_id"), "left").select("g.*", "l.unit_price", "l.quantity")
    of = last.select("category").distinct()
    base = valid.join(F.broadcast(of) if category else of, "category", "left_semi").crossJoin(lone).filter(~F.col("jv") | (F.col("tier") == JOINT_VENTURE))  # only the categories of the rows; one, if it is given
    # One baseline a category and sub-category, not one a row; blank sub-categories take the category's.
    counts = counted(base.withColumn("sub_category", F.coalesce("sub_category", F.lit(""))), ["category", "sub_category"])
    whole = lows(counts, ["category"]).select("category", F.struct("reasonable_low", "mean").alias("_whole"))
    part = lows(counts.filter("sub_category <> ''"), ["category", "sub_category"]).select("category", "sub_category", F.struct("reasonable_low", "mean").alias("_part"))
    dates = F.when(F.col("quote_date") != "", F.col("quote_date"))
    past = (quotes if quotes is not None else valid).join(F.broadcast(of) if category else of, "category", "left_semi").groupBy("category").agg(F.min(dates).alias("_from"), F.max(dates).alias("_to"), F.count(dates).alias("_dates"), F.countDistinct("project_id").alias("projects"))
    priced = bounds(cells.join(whole, "category", "left").join(part, ["category", "sub_category"], "left").join(past, "category", "left").crossJoin(lone), thresholds)
    basis = F.when(F.col("sub_category") != "", F.col("_part")).otherwise(F.col("_whole"))
    quantity = F.when(F.col("quantity") != 0, F.col("quantity")).otherwise(1.0)
    cells = priced.withColumn("reference", rounded(basis.reasonable_low, 2)).withColumn("historical_avg", rounded(basis.mean, 2))
    cells = cells.withColumn("deviation_pct", rounded(deviation(F.col("unit_price"), F.col("reference")), 4)).withColumn("total", rounded(F.col("unit_price") * F.coalesce(quantity, F.lit(1.0)), 2))
    cells = cells.withColumn("alert_level", alert(F.col("deviation_pct"), F.col("yellow"), F.col("red")))
    over = Window.partitionBy(*own)
    lowest = F.min(F.when(F.col("unit_price").isNotNull(), F.struct("unit_price", "position"))).over(over)
    best = F.min(F.when(F.col("deviation_pct").isNotNull(), F.struct("deviation_pct", "position"))).over(over)
    named = cells.withColumn("_low", lowest).withColumn("_best", best).join(suppliers.select(F.col("id").alias("supplier_id"), "name"), "supplier_id", "left")
    span = F.when(F.col("_dates") >= 2, F.concat_ws("~", "_from", "_to")).otherwise(F.coalesce("_from", F.lit("")))
    known = F.col("historical_avg").isNotNull()
    return saved(
        named.select(
            "group_id", "material_id", "material", "spec", "supplier_id", F.when(F.col("name").isNotNull(), letter(F.col("position"))).alias("label"), "name", F.col("unit_price").alias("price"), "total", "reference", "deviation_pct", "alert_level",
            (F.col("unit_price").isNotNull() & (F.col("_low.position") == F.col("position"))).alias("is_lowest"), F.col("_best.deviation_pct").alias("min_deviation"), letter(F.col("_best.position")).alias("recommended"),
            "historical_avg", F.when(known, span).alias("period"), F.when(known, F.coalesce("projects", F.lit(0))).alias("projects"), F.when(F.col("jv"), JOINT_VENTURE).alias("tier_filter"),
        )
    )


def totals(cells: DataFrame) -> DataFrame:
    """By supplier: total, avg_deviation (0 without any), quoted, rows, completeness, red."""
    return cells.groupBy("supplier_id", "label").agg(
        rounded(F.coalesce(F.sum("total"), F.lit(0.0)), 2).alias("total"), rounded(F.coalesce(F.avg("deviation_pct"), F.lit(0.0)), 4).alias("avg_deviation"), F.count("price").alias("quoted"),
        F.count("*").alias("rows"), rounded(F.count("price") / F.count("*"), 4).alias("completeness"), F.count_if(F.col("alert_level") == "red").alias("red"),
    )


def summary(cells: DataFrame) -> DataFrame:
    """best_supplier (least mean deviation), optimal_total (sum of the rows' least totals), red, savings_pct against the mean total."""
    per = totals(cells)
    least = cells.groupBy("group_id", "material_id").agg(F.min("total").alias("t")).agg(F.sum("t").alias("optimal_total"))
    of = per.agg(F.min(F.when(F.col("quoted") > 0, F.struct("avg_deviation", "label"))).alias("b"), F.sum("red").alias("red"), F.avg(F.when(F.col("total") > 0, F.col("total"))).alias("mean"), F.count_if(F.col("total") > 0).alias("n"))
    saved = F.when(F.col("n") >= 2, rounded(1 - F.col("optimal_total") / F.col("mean"), 4))
    return of.crossJoin(least).select(F.col("b.label").alias("best_supplier"), rounded(F.col("optimal_total"), 2).alias("optimal_total"), "red", saved.alias("savings_pct"))


def wide(cells: DataFrame, labels: list[str]) -> DataFrame:
    """One row a material, one price column a label, and a last row of totals."""
    rows = cells.groupBy("group_id", "material_id", "material").pivot("label", labels).agg(F.first("price")).drop("group_id")
    sums = cells.groupBy("label").agg(F.sum("total").alias("t")).groupBy().pivot("label", labels).agg(F.first("t"))
    return rows.unionByName(sums.select(F.lit(None).cast("long").alias("material_id"), F.lit("合计").alias("material"), *[F.col(x) for x in labels]))


def nested(cells: DataFrame) -> DataFrame:
    """One row a material with its cells in label order."""
    return cells.groupBy("group_id", "material_id", "material", "reference", "recommended").agg(F.array_sort(F.collect_list(F.struct("label", "price", "total", "deviation_pct", "alert_level", "is_lowest"))).alias("cells"))


def as_text(cells: DataFrame, most: int = 30, spec_length: int = 20) -> DataFrame:
    """The matrix as lines of text for a prompt: line_no, line; at most ``most`` rows, then how many there are."""
    cut = F.when(F.col("spec") != "", F.concat(F.lit(" ("), F.substring("spec", 1, spec_length), F.lit(")"))).otherwise("")
    money = lambda x: F.concat(F.lit("¥"), F.format_string("%.0f", x))
    dev = F.when(F.col("deviation_pct").isNull(), "—").otherwise(percent(F.col("deviation_pct")))
    cell = F.when(F.col("price").isNull(), "未报价").otherwise(F.concat(money(F.col("price")), F.lit(" "), dev, F.when(F.col("is_lowest"), " ★").otherwise("")))
    average = F.coalesce(money(F.col("historical_avg")), F.lit("—"))
    line = F.concat_ws(" | ", F.first(F.concat("material", cut)), F.first(average), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", cell.alias("t")))), lambda x: x.t), " | "))
    place = F.when(F.ascii("label") >= 65, F.ascii("label") - 64).otherwise(F.col("label").cast("int"))
    rows = cells.withColumn("_p", F.struct(F.coalesce(place, F.lit(1 << 20)).alias("p"), "supplier_id")).groupBy("group_id", "material_id").agg(line.alias("line"))
    # Aligned rows first; of at most ``most`` rows only.
    first = rows.orderBy(F.col("group_id").isNull(), "group_id", "material_id").limit(most)
    numbered = first.select(F.row_number().over(Window.orderBy(F.col("group_id").isNull(), "group_id", "material_id")).alias("line_no"), "line")
    more = rows.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(most + 1).alias("line_no"), F.concat(F.lit("...（共 "), "n", F.lit(f" 条，此处仅展示前 {most} 条）")).alias("line"))
    return numbered.unionByName(more)
