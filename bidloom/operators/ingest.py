"""Import of quote sheets: column detection, cleaning, dimension look-ups, summary."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidloom.functions.constants import COLUMN_PATTERNS, PROFESSIONS
from bidloom.functions.numbers import import_number, line_total, positive
from bidloom.functions.text import clean_cell, standardised

from .catalog import get_or_create


def detected_columns(columns: list[str]) -> dict[str, str | None]:
    """The header of each field: the first pattern that fits any header, its first header."""
    first = lambda p: next((c for c in columns if re.search(p, c)), None)
    return {field: next((c for p in patterns if (c := first(p))), None) for field, patterns in COLUMN_PATTERNS.items()}


def typed(sheet: DataFrame) -> DataFrame:
    """An all-string sheet (with ``line_no``) as fields: cleaned cells, numbers, rows without a name marked."""
    at = detected_columns([c for c in sheet.columns if c != "line_no"])
    cell = lambda f: clean_cell(F.col(f"`{at[f]}`")) if at[f] else F.lit(None).cast("string")
    number = lambda f: positive(import_number(cell(f)))
    out = sheet.select(
        "line_no", *[cell(f).alias(f) for f in ("name", "spec", "brand", "supplier", "material_type", "unit", "remark", "sub_category")],
        number("price").alias("unit_price"), number("price_excl").alias("unit_price_excl_tax"), number("quantity").alias("quantity"),
        reduce(lambda a, b: a | b, [cell(f).isNotNull() & import_number(cell(f)).isNull() for f in ("price", "price_excl", "quantity") if at[f]], F.lit(False)).alias("unread"),
    )
    return out.withColumn("total_price", line_total(F.col("unit_price"), F.col("quantity"))).withColumn("skipped", F.col("name").isNull())


def with_standard_names(rows: DataFrame) -> DataFrame:
    """Names are standardised once each, then joined back."""
    names = rows.select("name").distinct().withColumn("standard_name", standardised(F.col("name")).standardized)
    return rows.join(names, "name", "left")


def resolved_materials(rows: DataFrame, existing: DataFrame, category: str) -> DataFrame:
    """material_key of every row: the material it belongs to.

    With a specification, material and specification must agree; without one, the row
    belongs to the earliest material of its name, existing ones before those of the file.
    """
    old = existing.filter(F.col("category") == category).select(F.lit(0).alias("origin"), F.col("id").alias("seq"), "standard_name", F.coalesce("spec", F.lit("")).alias("spec"))
    new = rows.filter("NOT skipped").select(F.lit(1).alias("origin"), F.col("line_no").alias("seq"), "standard_name", F.coalesce("spec", F.lit("")).alias("spec"))
    everything = old.unionByName(new)
    by_spec = Window.partitionBy("standard_name", "spec").orderBy("origin", "seq")
    by_name = Window.partitionBy("standard_name").orderBy("origin", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    key = lambda w: F.first(F.struct("origin", "seq")).over(w)
    got = everything.withColumn("_key", F.when(F.col("spec") != "", key(by_spec)).otherwise(key(by_name)))
    return got.filter("origin = 1").select(F.col("seq").alias("line_no"), F.when(F.col("_key.origin") == 0, F.col("_key.seq")).alias("material_id"), F.when(F.col("_key.origin") == 1, F.col("_key.seq")).alias("new_from_line"))


def imported(
    sheet: DataFrame, materials: DataFrame, suppliers: DataFrame, tiers: DataFrame, category: str, batch_id: str, default_supplier_id: int | None = None, project_id: int | None = None, bid_status: str = "", most_errors: int = 50
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quotes of a sheet, the materials they need first, and a one-row summary.

    A supplier comes from its own column, never from the brand, else the default one. The
    summary: status, batch_id, imported, skipped, errors (rows with a price or quantity
    that can't be read, at most ``most_errors``), unknown_brands, supplier_ids. After the
    quotes and materials are stored, ``baseline.refreshed`` brings their reference prices
    up to date.
    """
    from .baseline import with_tier

    if category not in PROFESSIONS:
        raise ValueError(f"unknown category: {category}")
    rows = with_standard_names(typed(sheet))
    good = rows.filter("NOT skipped").withColumn("category", F.lit(category))
    ids = get_or_create(good.select(F.col("supplier").alias("name")), suppliers.select("id", "name")).select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    own = good.join(ids, "supplier", "left").withColumn("supplier_id", F.coalesce("supplier_id", F.lit(default_supplier_id).cast("long")))
    keyed = own.join(resolved_materials(rows, materials, category), "line_no")
    tiered = with_tier(keyed, tiers).withColumn("brand_tier", F.coalesce("tier", F.lit(""))).drop("tier")
    quotes = tiered.withColumn("project_id", F.lit(project_id).cast("long")).withColumn("batch_id", F.lit(batch_id)).withColumn("bid_status", F.lit(bid_status))
    first = quotes.filter("new_from_line = line_no")
    new = first.select("new_from_line", "standard_name", F.lit(PROFESSIONS[category]).alias("profession"), "category", F.coalesce("sub_category", F.lit("")).alias("sub_category"), F.coalesce("spec", F.lit("")).alias("spec"), "material_type", "unit", "brand")
    brands = F.array_sort(F.collect_set(F.when((F.col("brand_tier") == "") & (F.col("brand") != ""), F.col("brand"))))
    bad = F.when(~F.col("skipped") & F.col("unread"), F.struct((F.col("line_no") + 2).alias("row"), F.lit("a number can't be read").alias("reason")))
    counts = rows.agg(F.count_if(~F.col("skipped")).alias("imported"), F.count_if("skipped").alias("skipped"), F.slice(F.array_sort(F.collect_list(bad)), 1, most_errors).alias("errors"))
    found = quotes.agg(brands.alias("unknown_brands"), F.array_sort(F.collect_set("supplier_id")).alias("supplier_ids"))
    summary = counts.crossJoin(found).select(F.when(F.col("imported") > 0, "ok").otherwise("error").alias("status"), F.lit(batch_id).alias("batch_id"), "imported", "skipped", "errors", "unknown_brands", "supplier_ids")
    return quotes, new, summary


def batch_name(prefix: str, now: str | Column) -> Column:
    """A batch's name by its prefix and time (a text or a column): IMP-yyyymmdd-hhmmss."""
    at = (F.lit(now) if isinstance(now, str) else now).cast("timestamp")
    return F.concat_ws("-", F.lit(prefix), F.date_format(at, "yyyyMMdd"), F.date_format(at, "HHmmss"))
