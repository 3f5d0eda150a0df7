"""Queries of lists, exports, imports and texts, and the SQL each is checked against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.functions import numbers as N
from bidloom.functions import text as T
from bidloom.operators import catalog as C
from bidloom.operators import dashboard as D
from bidloom.operators import extract as E
from bidloom.operators import exports as O
from bidloom.operators import ingest as I
from bidloom.sources import files

from .domain import Domain
from .queries import PAGES, query, r, rounds, valid

TENDERS = """tenders AS (SELECT id, name AS project_name, CASE WHEN id % 3 = 0 THEN 'draft' ELSE 'open' END AS status, id % 5 AS n_items, '2024-' || lpad((id % 12 + 1)::VARCHAR, 2, '0') AS created_at FROM projects),
invitations AS (SELECT project_id AS tender_id, supplier_id, min(id) AS rank FROM quotes WHERE project_id IS NOT NULL AND batch_id % 4 = 0 GROUP BY ALL)"""


def _tenders(d: Domain) -> tuple[DataFrame, DataFrame]:
    items = F.slice(F.array(*[F.lit(f"i{k}") for k in range(5)]), 1, (F.col("id") % 5).cast("int"))
    tenders = d.projects.select("id", F.col("name").alias("project_name"), F.when(F.col("id") % 3 == 0, "draft").otherwise("open").alias("status"), items.alias("items"), F.concat(F.lit("2024-"), F.lpad((F.col("id") % 12 + 1).cast("string"), 2, "0")).alias("created_at"))
    asked = d.quotes.filter("project_id IS NOT NULL AND batch_id % 4 = 0").groupBy(F.col("project_id").alias("tender_id"), "supplier_id").agg(F.min("id").alias("rank"))
    return tenders, asked


@query(f""", {TENDERS} SELECT id, project_name, status, n_items::INTEGER AS item_count, coalesce((SELECT count(*) FROM invitations WHERE tender_id = id), 0) AS invitation_count, created_at FROM tenders ORDER BY created_at DESC, id LIMIT 50""")
def list_tenders(d):
    return C.tenders_listed(*_tenders(d))


@query(f""", {TENDERS} SELECT id, coalesce(n, 0)::INTEGER AS n_items, s AS suppliers FROM tenders LEFT JOIN (SELECT tender_id, count(*) AS n, string_agg(supplier_id::VARCHAR, ',' ORDER BY rank) AS s FROM invitations GROUP BY 1) ON tender_id = id""")
def tenders_with_invitations(d):
    tenders, asked = _tenders(d)
    return C.with_children(tenders.select("id"), asked, "tender_id", ["rank", "supplier_id"]).select("id", "n_items", F.array_join(F.transform("items", lambda x: x["supplier_id"].cast("string")), ",").alias("suppliers"))


@query(f""", {TENDERS} SELECT id, CASE WHEN status = 'draft' AND id IN (SELECT tender_id FROM invitations) THEN 'invited' ELSE status END AS status FROM tenders""")
def tenders_after_invitations(d):
    tenders, asked = _tenders(d)
    return C.tenders_after(tenders.select("id", "status"), asked)


@query(""" SELECT 7::BIGINT AS tender_id, id AS supplier_id, name AS supplier_name, CASE WHEN id % 4 = 0 THEN id WHEN id % 2 = 0 THEN id * 10 END AS rank, CASE WHEN id % 4 = 0 THEN 1.5 WHEN id % 2 = 0 THEN 9.5 END AS score, CASE WHEN id % 4 = 0 THEN 'accepted' ELSE 'pending' END AS status FROM suppliers WHERE id <= 40""")
def saved_invitations(d):
    s = d.suppliers
    before = s.filter("id % 4 = 0").select(F.lit(7).cast("long").alias("tender_id"), F.col("id").alias("supplier_id"), F.col("id").alias("rank"), F.lit(1.5).alias("score"), F.lit("accepted").alias("status"))
    advised = s.filter("id % 2 = 0").select(F.col("id").alias("supplier_id"), (F.col("id") * 10).alias("rank"), F.lit(9.5).alias("score"))
    return C.invited([*range(41), 10**9], s, advised, 7, before)


@query(""", i AS (SELECT group_id, count(*) AS n, string_agg(quote_id || action, ',' ORDER BY id) AS quotes FROM items GROUP BY 1) SELECT g.id, suggested_name, coalesce(n, 0)::INTEGER AS n_items, quotes FROM groups g LEFT JOIN i ON i.group_id = g.id WHERE status = 'confirmed'""")
def confirmed_alignments(d):
    return C.aligned(d.groups, d.items)[0].select("id", "suggested_name", "n_items", F.array_join(F.transform("items", lambda x: F.concat(x["quote_id"], x["action"])), ",").alias("quotes"))


@query(""" SELECT q.id AS quote_id, supplier_id, s.name AS supplier_name, standard_name AS material_name, spec, quantity, round(unit_price, 2) AS unit_price, total_price FROM valid q JOIN suppliers s ON s.id = q.supplier_id WHERE supplier_id IN (1, 2, 3, 4) AND category = 'PROMO' ORDER BY standard_name, s.name, q.id LIMIT 60""")
def alignment_request(d):
    return C.alignment_rows(valid(d, False), d.suppliers, [1, 2, 3, 4], category="PROMO").withColumn("unit_price", F.round("unit_price", 2))


@query(f""", live AS (SELECT id FROM groups WHERE status <> 'rejected'), fixed AS (SELECT quote_id, max(supplier_id) AS p FROM items WHERE action = 'ignore' AND supplier_id > 5 GROUP BY 1)
SELECT 'quote' AS kind, q.id, coalesce(p::DOUBLE, {r('unit_price', 2)}) AS unit_price, round(total_price, 2) AS total_price FROM quotes q LEFT JOIN fixed ON fixed.quote_id = q.id
UNION ALL SELECT 'group', id, NULL, NULL FROM live UNION ALL SELECT 'item', id, NULL, NULL FROM items WHERE group_id IN (SELECT id FROM live)""")
def alignment_applied(d):
    """Groups that were not rejected, their items, and the quotes with the prices that were fixed; totals stay."""
    fixes = d.items.filter("action = 'ignore'").select("quote_id", F.when(F.col("supplier_id") > 3, "unit_price").otherwise("quantity").alias("field"), F.when(F.col("supplier_id") > 5, F.col("supplier_id").cast("double")).alias("new_value"))
    groups, items, quotes = C.applied_alignment(d.groups, d.items, fixes, rounds(d.quotes.select("id", "unit_price", "total_price"), 2, "unit_price"))
    rows = quotes.select(F.lit("quote").alias("kind"), "id", "unit_price", F.round("total_price", 2).alias("total_price"))
    rest = [x.select(F.lit(k).alias("kind"), "id") for x, k in ((groups, "group"), (items, "item"))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [rows, *rest])


@query(""" SELECT event_id AS id, event_type AS type, CASE WHEN value > 50 THEN 'done' ELSE 'failed' END AS status FROM events WHERE event_type = 'view' AND value > 50 ORDER BY ts DESC, event_id LIMIT 50""")
def list_jobs(d):
    jobs = d._table("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.when(F.col("value") > 50, "done").otherwise("failed").alias("status"), F.col("ts").alias("created_at"))
    return E.jobs_listed(jobs, "view", "done").drop("created_at")


@query(""" SELECT q.id, standard_name AS material, spec, quote_date FROM quotes q JOIN materials m ON m.id = material_id WHERE spec = 11 AND quote_date >= '1998-01-01' AND quote_date <= '2000-06-30' ORDER BY q.id DESC LIMIT 100 OFFSET 100""")
def list_history(d):
    """Quotes of a specification and a time, second page."""
    m = d.materials.select(F.col("id").alias("material_id"), F.col("standard_name").alias("material"), "spec")
    rows = d.quotes.select("id", "material_id", "quote_date").join(m, "material_id").drop("material_id")
    return C.page(C.filtered(rows, {"spec": 11, "material": ""}, at_least={"quote_date": "1998-01-01"}, at_most={"quote_date": "2000-06-30"}), [F.desc("id")], 2, 100)


@query(""" SELECT s.id, s.name FROM suppliers s WHERE EXISTS (SELECT 1 FROM valid v WHERE v.supplier_id = s.id AND v.category = 'PROMO')""")
def suppliers_of_a_category(d):
    known = valid(d).groupBy(F.col("supplier_id").alias("id")).agg(F.collect_set("category").alias("categories"))
    return C.suppliers_in(d.suppliers.select("id", "name").join(known, "id"), "PROMO").drop("categories")


@query(""" SELECT '累计入库材料' AS "指标", count(*) AS "数值" FROM materials UNION ALL SELECT '供应商数', count(*) FROM suppliers UNION ALL SELECT '项目数', count(*) FROM projects UNION ALL SELECT '报价条数', count(*) FROM quotes""")
def export_totals(d):
    return O.totals_sheet(materials=d.materials, suppliers=d.suppliers, projects=d.projects, quotes=d.facts)


@query(""" SELECT category AS "品类", count(q.material_id) AS "报价条数", count(DISTINCT supplier_id) AS "供应商数" FROM materials m LEFT JOIN quotes q ON q.material_id = m.id GROUP BY category""")
def export_categories(d):
    return O.categories_sheet(d.materials, d.facts)


@query(""" SELECT id AS "ID", name AS "供应商名称", NULL AS "简称", NULL AS "联系人", NULL AS "电话", NULL AS "经营品类", win_count AS "中标次数", cooperation_score AS "合作评分", NULL AS "备注" FROM suppliers""")
def export_suppliers(d):
    return O.suppliers_sheet(d.suppliers)


@query(""" SELECT id AS "ID", NULL AS "物料编码", standard_name AS "标准名称", profession AS "专业", category AS "品类", sub_category AS "子类", spec AS "规格", NULL AS "材质", NULL AS "单位", brand AS "品牌", NULL AS "执行标准", NULL AS "参考均价" FROM materials WHERE category = 'PROMO'""")
def export_materials(d):
    return O.materials_sheet(d.materials, "PROMO")


@query(f""", v AS (SELECT q.id, m.standard_name, m.spec, m.category, s.name AS supplier, p.name AS project, q.unit_price, tax_rate, quantity, total_price, quote_date, {r('(unit_price - ref_price_median) / ref_price_median', 4)} AS dev
  FROM quotes q LEFT JOIN materials m ON m.id = q.material_id LEFT JOIN suppliers s ON s.id = supplier_id LEFT JOIN projects p ON p.id = project_id WHERE m.category = 'ECONOMY')
SELECT id AS "ID", standard_name AS "物料名称", spec AS "规格", category AS "品类", supplier AS "供应商", project AS "项目", unit_price AS "单价", NULL AS "单价(不含税)", tax_rate AS "税率", quantity AS "数量", total_price AS "总价",
  CASE WHEN dev IS NULL THEN '' ELSE printf('%.1f%%', {r('dev * 100', 1)}) END AS "偏差率", CASE WHEN dev > 0.1 THEN 'red' ELSE 'normal' END AS "告警", quote_date AS "报价日期" FROM v ORDER BY id DESC LIMIT 10000""")
def export_quotes(d):
    """The newest ten thousand quotes of a category as the sheet of the export."""
    m = d.materials.select(F.col("id").alias("material_id"), "ref_price_median")
    dev = N.rounded(N.deviation(F.col("unit_price"), F.col("ref_price_median")), 4)
    rows = d.quotes.join(m, "material_id", "left").withColumn("deviation_pct", dev).withColumn("alert_level", F.when(F.col("deviation_pct") > 0.1, "red").otherwise(""))
    return O.quotes_sheet(rows.drop("ref_price_median"), d.materials, d.suppliers, d.projects, category="ECONOMY")


@query(""", c AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN '¥' || p_size || '.50' WHEN 1 THEN p_size || ',5' WHEN 2 THEN p_size || '，25元' WHEN 3 THEN '-' || p_size WHEN 4 THEN 'abc' WHEN 5 THEN '1,' || lpad(p_size::VARCHAR, 3, '0') || ' 元' WHEN 6 THEN '' END AS cell, p_size AS n FROM part)
SELECT id, CASE id % 8 WHEN 0 THEN n + 0.5 WHEN 1 THEN n + 0.5 WHEN 2 THEN n + 0.25 WHEN 3 THEN -n WHEN 5 THEN ('1.' || lpad(n::VARCHAR, 3, '0'))::DOUBLE END::DOUBLE AS imported, CASE id % 8 WHEN 0 THEN n + 0.5 WHEN 1 THEN (n || '5')::DOUBLE WHEN 2 THEN (n || '25')::DOUBLE WHEN 3 THEN -n WHEN 5 THEN 1000 + n END::DOUBLE AS extracted,
  CASE id % 8 WHEN 3 THEN NULL ELSE CASE id % 8 WHEN 0 THEN n + 0.5 WHEN 1 THEN n + 0.5 WHEN 2 THEN n + 0.25 WHEN 5 THEN ('1.' || lpad(n::VARCHAR, 3, '0'))::DOUBLE END END::DOUBLE AS price FROM c""")
def cell_numbers(d):
    """Numbers as people write them, by the rules of imported sheets and of extracted documents."""
    n, k = F.col("p_size").cast("string"), F.col("p_partkey") % 8
    cell = F.when(k == 0, F.concat(F.lit("¥"), n, F.lit(".50"))).when(k == 1, F.concat(n, F.lit(",5"))).when(k == 2, F.concat(n, F.lit("，25元"))).when(k == 3, F.concat(F.lit("-"), n)).when(k == 4, "abc").when(k == 5, F.concat(F.lit("1,"), F.lpad(n, 3, "0"), F.lit(" 元"))).when(k == 6, "")
    rows = d._table("part").select(F.col("p_partkey").alias("id"), cell.alias("cell"))
    return rows.select("id", N.import_number(F.col("cell")).alias("imported"), N.extraction_number(F.col("cell")).alias("extracted"), N.positive(N.import_number(F.col("cell"))).alias("price"))


# Names, the categories they mention, the first one by plain text, their category's sub-category.
NAMES = [
    ("止回阀门 DN50", "", "阀门", "阀门", "止回阀"), ("阀门 DN100", "阀门", "阀门", "阀门", "其他阀门"), ("DN100 阀门", "阀门", "阀门", "阀门", "其他阀门"), ("低压母线槽 1000A", "母线槽", "母线槽", "母线槽", "母线槽"), ("桥架", "桥架", "桥架", "桥架", "普通桥架"),
    ("防水槽式桥架", "", "桥架", "桥架", "槽式桥架"), ("nothing", "", None, "水箱", "其他"), (None, "", None, "阀门", "未分类"), ("Y型过滤器", "", None, "阀门", "过滤器"), ("防火阀 fd", "", None, "风口风阀", "防火阀"),
]


@query(' SELECT id, x.mentioned AS mentioned, x."first" AS "first", x.sub AS sub FROM (SELECT id, n[id % 10 + 1] AS x FROM materials, (SELECT [' + ", ".join("{'mentioned': %s, 'first': %s, 'sub': %s}" % tuple("NULL" if x is None else f"'{x}'" for x in (m, f, s)) for _, m, f, _, s in NAMES) + "] AS n))")
def names_categories(d):
    """Categories and sub-categories read from names."""
    kind = "struct<name:string,category:string>"
    names = F.element_at(F.array(*[F.struct(F.lit(n).cast("string").alias("name"), F.lit(c).alias("category")) for n, _, _, c, _ in NAMES]).cast(f"array<{kind}>"), (F.col("id") % 10 + 1).cast("int"))
    rows = d.materials.select("id", names.alias("n")).select("id", "n.*")
    return rows.select("id", F.array_join(T.categories_in(F.col("name")), ",").alias("mentioned"), T.first_category(F.col("name")).alias("first"), T.sub_category(F.col("name"), F.col("category")).alias("sub"))


@query(r""" SELECT id, CASE id % 4 WHEN 0 THEN 'noctx' WHEN 1 THEN substr(sha256('{"category": "' || category || '", "supplier_id": ' || id || '}'), 1, 16) WHEN 2 THEN substr(sha256('{"project_id": ' || id || '}'), 1, 16) ELSE substr(sha256('{"category": "甲\"乙", "project_id": "x7"}'), 1, 16) END AS hash, 'IMP-20240203-' || lpad((id % 24)::VARCHAR, 2, '0') || '0506' AS batch FROM materials""")
def context_hashes(d):
    """Contexts by the digest of their JSON, and names of batches."""
    key = F.col("id").cast("string")
    given = F.when(F.col("id") % 4 == 0, F.create_map(F.lit("note"), F.lit("x"), F.lit("category"), F.lit(""))).when(F.col("id") % 4 == 1, F.create_map(F.lit("supplier_id"), key, F.lit("category"), F.col("category")))
    given = given.when(F.col("id") % 4 == 2, F.create_map(F.lit("project_id"), key, F.lit("note"), F.lit("y"))).otherwise(F.create_map(F.lit("project_id"), F.lit("x7"), F.lit("category"), F.lit('甲"乙')))
    at = F.concat(F.lit("2024-02-03 "), F.lpad((F.col("id") % 24).cast("string"), 2, "0"), F.lit(":05:06"))
    return d.materials.select("id", E.context_hash(given).alias("hash"), I.batch_name("IMP", at).alias("batch"))


@query(f""", pages AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(PAGES)}) AS page FROM lineitem),
firsts AS (SELECT *, 'M' || (l_partkey % 3) || CASE WHEN l_partkey % 2 = 0 THEN ' 阀门' ELSE '' END AS name FROM pages WHERE l_partkey % 5 > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3, l_partkey % 2, l_linenumber ORDER BY page) = 1)
SELECT l_orderkey::VARCHAR AS doc_id, any_value(n) AS pages, string_agg(name || '|' || CASE WHEN l_partkey % 7 = 0 THEN '给定' WHEN l_partkey % 2 = 0 THEN '阀门' ELSE '-' END || '|' || l_linenumber || '.0|' || CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END, ';' ORDER BY page) AS items
FROM firsts JOIN (SELECT l_orderkey, count(*) AS n FROM pages GROUP BY 1) USING (l_orderkey) GROUP BY l_orderkey""")
def tender_extractions(d):
    """Tenders from their pages: items in order without repeats, nameless ones gone, categories inferred where none is given."""
    from pyspark.sql import Window

    line = d._table("lineitem").withColumn("page", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*PAGES)))
    key, text = F.col("l_partkey"), lambda x: F.lit(x).cast("string")
    name = F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit("M"), key % 3, F.when(key % 2 == 0, " 阀门").otherwise("")))
    attrs = F.create_map(text("a"), F.when(key % 11 == 0, "v").otherwise(" "))
    item = F.struct(name.alias("name"), F.when(key % 7 == 0, "给定").otherwise("").alias("category"), text("").alias("spec"), F.col("l_linenumber").cast("string").alias("quantity"), attrs.alias("attrs"))
    head = F.struct(F.concat(F.lit("P"), "l_orderkey").alias("project_name"), F.array(item).alias("items"))
    partials = line.select(F.col("l_orderkey").cast("string").alias("doc_id"), "page", F.to_json(head).alias("data"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("tokens_used"), F.lit(1).cast("long").alias("duration_ms"))
    docs = E.merged(partials, "tender").select("doc_id", "pages", E.tender_items(F.col("items")).alias("items")).filter(F.size("items") > 0)
    told = F.transform("items", lambda x: F.concat_ws("|", x["name"], F.coalesce(x["category"], F.lit("-")), x["quantity"].cast("string"), F.size(x["attrs"])))
    return docs.select("doc_id", "pages", F.array_join(told, ";").alias("items"))


@query(""", s AS (SELECT id, ['汇总', 'Sheet1', '一期', '技术参数', '二期 '][id % 5 + 1] AS sheet, ['阀门', '水箱', '桥架'][id % 3 + 1] AS category, id % 50 AS n FROM projects)
SELECT category, count(*) FILTER (sheet IN ('一期', '二期 ')) AS n_projects, CASE category WHEN '桥架' THEN 1 WHEN '阀门' THEN 4 ELSE 6 END::INTEGER AS place, arg_min(id, (sheet <> '汇总', -n, id)) AS summary FROM s GROUP BY category""")
def sheets_by_category(d):
    """What a manifest tells of categories: project sheets, the summary sheet, the category's place."""
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("id") % n + 1).cast("int"))
    entries = d.projects.select(F.lpad("id", 9, "0").alias("csv"), pick(["汇总", "Sheet1", "一期", "技术参数", "二期 "], 5).alias("sheet"), pick(["阀门", "水箱", "桥架"], 3).alias("category"), (F.col("id") % 50).cast("int").alias("rows"))
    chosen = files.summary_sheets(entries).select("category", F.col("csv").cast("long").alias("summary"))
    return files.project_counts(entries).join(chosen, "category").select("category", "n_projects", files.category_order(F.col("category")).alias("place"), "summary")


@query(f""", f AS (SELECT p_partkey AS id, ['阀门', '水箱'][p_partkey % 2 + 1] AS category, ['闸阀', '蝶阀 x', '水箱', '不知'][p_partkey % 4 + 1] AS name, CASE WHEN p_partkey % 9 > 0 THEN p_retailprice * (p_partkey % 4 + 1) END AS price, CASE WHEN p_partkey % 10 > 0 THEN p_brand ELSE '12' END AS brand FROM part),
k AS (SELECT *, CASE WHEN category = '阀门' AND name = '闸阀' THEN '闸阀' WHEN category = '水箱' AND name = '水箱' THEN '不锈钢水箱' ELSE '其他' END AS sub FROM f),
w AS (SELECT category, count(*) AS n_total, count(price) AS n_valid_price, count(DISTINCT CASE WHEN brand <> '12' THEN brand END)::INTEGER AS n_brands FROM k GROUP BY 1),
s AS (SELECT category, sub AS sub_category, count(*) AS count, {r('avg(price)', 2)} AS mean, {r('quantile_cont(price, 0.5)', 2)} AS median, {r('stddev_samp(price)', 2)} AS std, {r('stddev_samp(price) / avg(price)', 3)} AS cv, {r('min(price)', 2)} AS min, {r('max(price)', 2)} AS max, {r('quantile_cont(price, 0.1)', 2)} AS p10, {r('quantile_cont(price, 0.9)', 2)} AS p90 FROM k WHERE price > 0 GROUP BY 1, 2)
SELECT category, n_total, n_valid_price, n_brands, CASE category WHEN '阀门' THEN 2 ELSE 0 END::BIGINT AS n_projects, s.* EXCLUDE (category), {r('greatest(cv * 1.5::DOUBLE, 0.05::DOUBLE)', 3)} AS suggested_threshold, (row_number() OVER (PARTITION BY category ORDER BY count DESC, sub_category) - 1)::INTEGER AS place FROM w JOIN s USING (category)""")
def file_analysis(d):
    """What the files of categories hold: sizes, brands, projects and prices by sub-category."""
    key = F.col("p_partkey")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))
    rows = d._table("part").select(pick(["阀门", "水箱"]).alias("category"), pick(["闸阀", "蝶阀 x", "水箱", "不知"]).alias("name"), F.when(key % 9 > 0, F.col("p_retailprice") * (key % 4 + 1)).alias("price"), F.when(key % 10 > 0, F.col("p_brand")).otherwise("12").alias("brand"), F.lit("").alias("remark"))
    entries = d.spark.createDataFrame([("a", "汇总", "阀门", 1), ("b", "一期", "阀门", 1), ("c", "二期", "阀门", 1), ("d", "Sheet9", "水箱", 1)], "csv string, sheet string, category string, rows int")
    out = D.file_analysis(rows, entries).select("category", "n_total", "n_valid_price", "n_brands", "n_projects", F.posexplode("price_stats").alias("place", "s"))
    return out.select("category", "n_total", "n_valid_price", "n_brands", "n_projects", "place", "s.*")
