"""Procurement tables seen in the order tables, as DataFrames and as SQL.

Both forms define the same rows: ``Domain`` for Spark, ``CTES`` for the SQL that the
queries are checked against.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Alert bounds of the mapped categories.
BOUNDS = {"STANDARD": (0.08, 0.15), "MEDIUM": (0.06, 0.12), "default": (0.05, 0.10)}
NOW = "2001-12-01"

CTES = """
base AS (SELECT l_orderkey * 100 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id, * FROM lineitem),
quotes AS (SELECT id, l_partkey AS material_id, l_suppkey AS supplier_id,
    CASE WHEN o_orderpriority = '5-LOW' AND l_linenumber = 1 THEN NULL ELSE o_custkey END AS project_id,
    CASE WHEN l_linenumber = 7 AND l_quantity >= 45 THEN NULL ELSE l_extendedprice / l_quantity END AS unit_price,
    CASE WHEN l_linenumber = 6 AND l_quantity < 3 THEN NULL ELSE l_quantity END AS quantity, l_extendedprice AS total_price, l_tax AS tax_rate,
    p_brand AS brand, CASE WHEN l_linestatus = 'F' AND l_quantity < 3 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS quote_date,
    l_orderkey AS batch_id, CASE WHEN l_returnflag = 'R' THEN '未中标' ELSE '中标' END AS bid_status, l_discount AS created
  FROM base JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
materials AS (SELECT p_partkey AS id, p_name AS standard_name, p_type AS category,
    CASE WHEN p_size % 7 = 0 THEN '' ELSE 'G' || (p_size // 10) END AS sub_category, p_size AS spec, p_brand AS brand,
    CASE WHEN p_type IN ('STANDARD', 'MEDIUM') THEN '电气' WHEN p_type IN ('ECONOMY', 'PROMO') THEN '给排水' WHEN p_type = 'LARGE' THEN '暖通' ELSE '其他' END AS profession,
    CASE WHEN p_partkey % 17 = 0 THEN 'disabled' WHEN p_partkey % 19 = 0 THEN NULL ELSE 'active' END AS status,
    CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS ref_price_reasonable_low, p_retailprice * 1.5 AS ref_price_median FROM part),
suppliers AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 7 AS win_count, s_acctbal / 100 AS cooperation_score, s_suppkey % 41 + 60 AS ai_score, CASE WHEN s_nationkey % 3 = 0 THEN '2001-0' || (s_nationkey % 9 + 1) ELSE '2000-12' END AS last_cooperation FROM supplier),
projects AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS status FROM customer),
brands AS (SELECT DISTINCT p_brand AS brand_name, substr(p_brand, 7)::INTEGER AS k FROM part),
brand_tiers AS (SELECT brand_name, CASE k % 5 WHEN 3 THEN '国产' WHEN 4 THEN '进口' ELSE '合资' END AS tier, NULL::VARCHAR AS category FROM brands WHERE k % 5 <> 0
  UNION ALL SELECT brand_name, '国产', 'ECONOMY' FROM brands WHERE k % 3 = 0),
valid AS (SELECT q.*, m.category, m.sub_category, m.standard_name, m.spec, m.profession, m.ref_price_reasonable_low, m.ref_price_median
  FROM quotes q JOIN materials m ON q.material_id = m.id WHERE q.unit_price > 0),
groups AS (SELECT o_orderkey AS id, o_custkey AS project_id, 'PROMO' AS category, 'G' || o_orderkey AS suggested_name, o_orderstatus AS suggested_spec,
    CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'P' THEN 'rejected' ELSE 'suggested' END AS status FROM orders),
items AS (SELECT id, batch_id AS group_id, id AS quote_id, supplier_id, CASE WHEN id % 5 = 0 THEN 'ignore' ELSE 'align' END AS action FROM quotes),
tiered AS (SELECT v.*, coalesce(s.tier, g.tier) AS tier FROM valid v LEFT JOIN brand_tiers s ON s.brand_name = v.brand AND s.category = v.category
  LEFT JOIN brand_tiers g ON g.brand_name = v.brand AND g.category IS NULL)
"""


def with_ctes(sql: str) -> str:
    """``sql`` (a SELECT, or further CTEs and a SELECT) after the domain's CTEs."""
    return f"WITH {CTES}{sql if sql.lstrip().startswith(',') else ' ' + sql}"


@dataclass
class Domain:
    spark: SparkSession
    sf_dir: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def quotes(self) -> DataFrame:
        line = self._table("lineitem")
        order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
        return self._quotes(line.withColumn("id", F.col("l_orderkey") * 100 + number))

    @cached_property
    def facts(self) -> DataFrame:
        """Quotes without their id: no window, so no sort by order."""
        return self._quotes(self._table("lineitem")).drop("id")

    def _quotes(self, line: DataFrame) -> DataFrame:
        orders = self._table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        part = self._table("part").select("p_partkey", "p_brand")
        q = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        number = F.col("id") if "id" in line.columns else F.lit(None).cast("long")
        n, qty = F.col("l_linenumber"), F.col("l_quantity")
        return q.select(
            number.alias("id"),
            F.col("l_partkey").alias("material_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.when((F.col("o_orderpriority") == "5-LOW") & (n == 1), None).otherwise(F.col("o_custkey")).alias("project_id"),
            F.when((n == 7) & (qty >= 45), None).otherwise(F.col("l_extendedprice") / qty).alias("unit_price"),
            F.when((n == 6) & (qty < 3), None).otherwise(qty).alias("quantity"),
            F.col("l_extendedprice").alias("total_price"),
            F.col("l_tax").alias("tax_rate"),
            F.col("p_brand").alias("brand"),
            F.when((F.col("l_linestatus") == "F") & (qty < 3), "").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("quote_date"),
            F.col("l_orderkey").alias("batch_id"),
            F.when(F.col("l_returnflag") == "R", "未中标").otherwise("中标").alias("bid_status"),
            F.col("l_discount").alias("created"),
        )

    @cached_property
    def materials(self) -> DataFrame:
        kind, key, size = F.col("p_type"), F.col("p_partkey"), F.col("p_size")
        return self._table("part").select(
            key.alias("id"),
            F.col("p_name").alias("standard_name"),
            kind.alias("category"),
            F.when(size % 7 == 0, "").otherwise(F.concat(F.lit("G"), F.expr("p_size div 10"))).alias("sub_category"),
            size.alias("spec"),
            F.col("p_brand").alias("brand"),
            F.when(kind.isin("STANDARD", "MEDIUM"), "电气").when(kind.isin("ECONOMY", "PROMO"), "给排水").when(kind == "LARGE", "暖通").otherwise("其他").alias("profession"),
            F.when(key % 17 == 0, "disabled").when(key % 19 == 0, None).otherwise("active").alias("status"),
            F.when(key % 5 != 0, F.col("p_retailprice")).alias("ref_price_reasonable_low"),
            (F.col("p_retailprice") * 1.5).alias("ref_price_median"),
        )

    @cached_property
    def categorised(self) -> DataFrame:
        """All quotes with their category and sub-category."""
        return self.facts.join(self.materials.select(F.col("id").alias("material_id"), "category", "sub_category"), "material_id")

    @cached_property
    def priced(self) -> DataFrame:
        """All quotes with their category and their material's reference prices."""
        return self.facts.join(self.materials.select(F.col("id").alias("material_id"), "category", "ref_price_reasonable_low", "ref_price_median"), "material_id")

    @cached_property
    def groups(self) -> DataFrame:
        """Alignment groups: one for every order of a customer, most of them confirmed."""
        o = self._table("orders")
        return o.select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id"), F.lit("PROMO").alias("category"), F.concat(F.lit("G"), "o_orderkey").alias("suggested_name"), F.col("o_orderstatus").alias("suggested_spec"),
            F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "P", "rejected").otherwise("suggested").alias("status"),
        )

    @cached_property
    def items(self) -> DataFrame:
        """Their items: the orders' quotes."""
        q = self.quotes
        return q.select(F.col("id"), F.col("batch_id").alias("group_id"), F.col("id").alias("quote_id"), "supplier_id", F.when(F.col("id") % 5 == 0, "ignore").otherwise("align").alias("action"))

    @cached_property
    def suppliers(self) -> DataFrame:
        return self._table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).alias("win_count"), (F.col("s_acctbal") / 100).alias("cooperation_score"), (F.col("s_suppkey") % 41 + 60).alias("ai_score"), F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("2001-0"), F.col("s_nationkey") % 9 + 1)).otherwise("2000-12").alias("last_cooperation"))

    @cached_property
    def projects(self) -> DataFrame:
        return self._table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("status"))

    @cached_property
    def brand_tiers(self) -> DataFrame:
        brands = self._table("part").select(F.col("p_brand").alias("brand_name")).distinct().withColumn("k", F.substring("brand_name", 7, 9).cast("int"))
        generic = brands.filter("k % 5 <> 0").select("brand_name", F.when(F.col("k") % 5 == 3, "国产").when(F.col("k") % 5 == 4, "进口").otherwise("合资").alias("tier"), F.lit(None).cast("string").alias("category"))
        return generic.unionByName(brands.filter("k % 3 = 0").select("brand_name", F.lit("国产").alias("tier"), F.lit("ECONOMY").alias("category")))

    @cached_property
    def thresholds(self) -> DataFrame:
        return self.spark.createDataFrame([(c, *b) for c, b in BOUNDS.items()], "category string, yellow double, red double")
