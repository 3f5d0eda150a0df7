"""Load of a company's history: many sheets to projects, suppliers, materials and quotes, with numbers given over all of them at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidloom.functions.constants import PROFESSIONS
from bidloom.functions.numbers import positive
from bidloom.functions.text import sub_category
from bidloom.sources import files, sinks
from bidloom.sources.shared import saved

from .catalog import code_prefix, code_text, numbered, placed

#: The category whose sheets are lists of boxes: each of its sheets is read, and names a project.
BOXES = "配电箱"
ORDER = [*files.LAYOUTS, BOXES]
#: The tables of a load, in the order in which they are written.
TABLES = ("history", "projects", "suppliers", "materials", "quotes")


def history(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """The rows of all sheets that count: of each category its summary sheet, of the boxes every sheet.

    lines: csv, line_no, cells; entries: the manifest. A row without a name is called by
    its category; prices and quantities that are not positive are none.
    """
    chosen = files.summary_sheets(entries.filter(F.col("category") != BOXES)).unionByName(entries.filter(F.col("category") == BOXES))
    tagged = saved(lines.select("csv", "line_no", "cells").join(chosen.select("csv", "category"), "csv").withColumnRenamed("csv", "path"))
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))

    def of(category: str) -> DataFrame:
        rows = files.category_rows(tagged.filter(F.col("category") == category), category)
        return rows.select(
            F.lit(ORDER.index(category)).alias("place"), "path", "line_no", "category", F.when(F.trim("name") != "", F.trim("name")).alias("name"), text("spec").alias("spec"), text("material_type").alias("material_type"),
            text("unit").alias("unit"), text("brand").alias("brand"), positive(F.col("price")).alias("unit_price"), positive(F.col("price_excl")).alias("unit_price_excl_tax"), positive(F.col("quantity")).alias("quantity"), text("remark").alias("remark"),
            F.lit(None).cast("string").alias("project"),
        )

    boxes = files.box_totals(tagged.filter(F.col("category") == BOXES)).join(entries.select(F.col("csv").alias("path"), F.trim("sheet").alias("project")), "path")
    none = {c: F.lit(None).cast("double") for c in ("unit_price_excl_tax", "quantity")} | {c: F.lit("") for c in ("spec", "material_type", "brand", "remark")}
    named = boxes.select(F.lit(ORDER.index(BOXES)).alias("place"), "path", "line_no", F.lit(BOXES).alias("category"), F.trim("box").alias("name"), F.col("price").alias("unit_price"), F.lit("台").alias("unit"), "project")
    rows = reduce(DataFrame.unionByName, [*map(of, files.LAYOUTS), named.withColumns(none)])
    return rows.withColumns({"sub_category": sub_category(F.col("name"), F.col("category")), "name": F.coalesce("name", "category")})


def _profession(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in PROFESSIONS.items() for x in kv]), category)


def loaded(spark: SparkSession, lines: DataFrame, entries: DataFrame, out: str) -> dict[str, DataFrame]:
    """The tables of ``TABLES`` below ``out``, written one after the other, each whole.

    Numbers are given once, in the table of the history: by category, file and line. A
    load that died goes on with the table it died in, and gives the same numbers.
    Every row is a material of its own and a quote for it; brands are the suppliers.
    """
    path = {t: f"{out}/{t}" for t in TABLES}

    def write(name: str, frame) -> DataFrame:
        if not sinks.exists(spark, f"{path[name]}/_SUCCESS"):
            sinks.swapped(frame(), path[name])
        return spark.read.parquet(path[name])

    rows = write("history", lambda: placed(saved(history(lines, entries)), ["place", "path", "line_no"]).withColumnRenamed("_k", "id"))
    projects = write("projects", lambda: numbered(files.project_names(entries), "name").select(F.col("_k").alias("id"), "name"))
    suppliers = write("suppliers", lambda: numbered(rows.filter("brand <> ''").select(F.col("brand").alias("name")).distinct(), "name").select(F.col("_k").alias("id"), "name"))

    def materials() -> DataFrame:
        first = rows.groupBy("category").agg(F.min("id").alias("_first"))  # a row a category
        code = F.concat_ws("-", code_prefix(_profession(F.col("category")), F.col("category")), code_text(F.col("id") - F.col("_first") + 1))
        numbers = rows.join(F.broadcast(first), "category")
        return numbers.select("id", code.alias("material_code"), F.col("name").alias("standard_name"), _profession(F.col("category")).alias("profession"), "category", "sub_category", "spec", "material_type", "unit", "brand")

    def quotes() -> DataFrame:
        own = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
        return rows.join(own, "project", "left").select("id", F.col("id").alias("material_id"), "project_id", "unit_price", "unit_price_excl_tax", "quantity", "brand", "remark")

    return {"projects": projects, "suppliers": suppliers, "materials": write("materials", materials), "quotes": write("quotes", quotes)}
