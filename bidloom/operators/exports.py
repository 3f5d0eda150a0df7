"""The sheets of the exports as frames, with their headings; ``sources.sinks.xlsx`` writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.numbers import rounded
from bidloom.sources.sinks import EXPORT_ROWS

from .catalog import filtered, named_quotes
from .dashboard import export_statistics

# Headings and the columns below them.
SUPPLIERS = {"ID": "id", "供应商名称": "name", "简称": "short_name", "联系人": "contact", "电话": "phone", "经营品类": "categories", "中标次数": "win_count", "合作评分": "cooperation_score", "备注": "remark"}
MATERIALS = {
    "ID": "id", "物料编码": "material_code", "标准名称": "standard_name", "专业": "profession", "品类": "category", "子类": "sub_category", "规格": "spec",
    "材质": "material_type", "单位": "unit", "品牌": "brand", "执行标准": "exec_standard", "参考均价": "ref_price_avg",
}
QUOTES = {
    "ID": "id", "物料名称": "material", "规格": "spec", "品类": "category", "供应商": "supplier", "项目": "project", "单价": "unit_price", "单价(不含税)": "unit_price_excl_tax", "税率": "tax_rate",
    "数量": "quantity", "总价": "total_price", "偏差率": "deviation", "告警": "alert_level", "报价日期": "quote_date",
}
TOTALS = {"累计入库材料": "materials", "供应商数": "suppliers", "项目数": "projects", "报价条数": "quotes"}


def _headed(rows: DataFrame, heads: dict[str, str]) -> DataFrame:
    """Columns under their headings; those that the rows lack stay empty."""
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None).cast("string")).alias(h) for h, c in heads.items()])


def totals_sheet(**tables: DataFrame) -> DataFrame:
    """指标 and 数值: the sizes of the four tables."""
    frames = [tables[name].agg(F.count("*").alias("数值")).select(F.lit(label).alias("指标"), "数值") for label, name in TOTALS.items()]
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def categories_sheet(materials: DataFrame, quotes: DataFrame) -> DataFrame:
    """品类, 报价条数 and 供应商数, most quotes first."""
    rows = export_statistics(materials, quotes)
    return rows.select(F.col("category").alias("品类"), F.col(rows.columns[1]).alias("报价条数"), F.col(rows.columns[2]).alias("供应商数")).orderBy(F.desc("报价条数"), "品类")


def suppliers_sheet(suppliers: DataFrame) -> DataFrame:
    return _headed(suppliers, SUPPLIERS).orderBy("ID")


def materials_sheet(materials: DataFrame, category: str | None = None) -> DataFrame:
    return _headed(filtered(materials, {"category": category}), MATERIALS).orderBy("专业", "品类", "ID")


def percent(share: Column) -> Column:
    """A share as per cent with one digit; empty if there is none."""
    return F.when(share.isNotNull(), F.format_string("%.1f%%", rounded(share * 100, 1))).otherwise("")


def quotes_sheet(quotes: DataFrame, materials: DataFrame, suppliers: DataFrame, projects: DataFrame, most: int = EXPORT_ROWS, **equal) -> DataFrame:
    """The newest quotes, at most ``most``, optionally of a category, supplier, project or alert level."""
    spec = materials.select(F.col("id").alias("material_id"), "spec")
    rows = filtered(named_quotes(quotes, materials, suppliers, projects).join(spec, "material_id", "left"), equal)
    rows = rows.withColumn("deviation", percent(F.col("deviation_pct"))).withColumn("alert_level", F.when(F.col("alert_level") != "", F.col("alert_level")).otherwise("normal"))
    return _headed(rows.withColumn("quote_date", F.coalesce("quote_date", F.lit(""))), QUOTES).orderBy(F.desc("ID")).limit(most)
