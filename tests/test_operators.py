import numpy as np
import pytest
from pyspark.sql import functions as F

from bidloom.functions import numbers as N
from bidloom.functions import text as T
from bidloom.operators import baseline as B
from bidloom.operators import catalog as C
from bidloom.operators import dashboard as D
from bidloom.operators import extract as E
from bidloom.operators import ingest as I
from bidloom.operators import matrix as M
from bidloom.operators import recommend as R
from bidloom.operators import scoring as S
from bidloom.operators.scoring import checked_weights

PRICES = [45.0, 48.0, 50.0, 52.0, 55.0, 53.0, 47.0, 51.0]
QUOTE = "id long, material_id long, supplier_id long, project_id long, unit_price double, quantity double, brand string, quote_date string, bid_status string"
MATERIAL = "id long, standard_name string, category string, sub_category string, spec string, profession string, ref_price_reasonable_low double, ref_price_median double"


def frames(spark, prices=PRICES):
    quotes = spark.createDataFrame([(i, 1, 1, 1, p, 100.0, "测试供应商A", "", "") for i, p in enumerate(prices)], QUOTE)
    return quotes, spark.createDataFrame([(1, "托盘式热浸镀锌桥架", "桥架", "托盘式桥架", "300×150", "电气", None, 50.0)], MATERIAL)


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_baseline_of_eight_quotes(spark):
    row = B.baseline(B.counted(B.valid(*frames(spark)), ["category"]), ["category"]).first()
    assert (row["count"], row.filtered_count, row.reasonable_low, row.median, row["mean"]) == (8, 8, 45.0, 50.5, 50.125)
    assert (row.iqr_lower, row.iqr_upper) == (41.0, 59.0) and abs(row["std"] - np.std(PRICES, ddof=1)) < 1e-9


@pytest.mark.parametrize("prices", [[5.0], [1.0, 1000.0], [3.0] * 9, [1.5, 2.5, 2.5, 9.0, 400.0], [*np.random.default_rng(1).lognormal(3, 2, 500).round(2)]])
def test_quantiles_equal_numpy(spark, prices):
    p = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.5, "e": 0.9, "f": 1.0}
    row = B.quantiles(B.ranked(B.counted(spark.createDataFrame([("k", float(x)) for x in prices], "k string, unit_price double"), ["k"]), ["k"]), ["k"], p).first()
    assert row.n == len(prices)
    for name, q in p.items():
        assert abs(row[name] - np.quantile(prices, q)) < 1e-9


def test_outliers_are_filtered_and_low_has_its_source(spark):
    quotes, materials = frames(spark, [*PRICES, 0.01, None, -3.0, 45.0])
    valid = B.valid(quotes, materials)
    row = B.reasonable_low(valid, ["category"], spark.createDataFrame([(1, "测试项目一期")], "id long, name string")).first()
    assert (row.reasonable_low, row.quote_id, row.project_name, row.historical_min) == (45.0, 0, "测试项目一期", 0.01)


def test_refresh_counts_brands(spark):
    row = B.refreshed(B.valid(*frames(spark))).first()
    assert (row.ref_price_reasonable_low, row.ref_price_median, row.supplier_count) == (45.0, 50.5, 1)


@pytest.mark.parametrize("dev,want", [(0.05, "normal"), (-0.05, "normal"), (0.10, "yellow"), (-0.1, "yellow"), (0.15, "red"), (None, "normal")])
def test_alert_bounds(spark, dev, want):
    assert one(spark, lambda x: N.alert(x, F.lit(0.05), F.lit(0.10)), dev, "double") == want


@pytest.mark.parametrize("cell,imp,ext", [("123.45", 123.45, 123.45), ("123,45", 123.45, 12345.0), ("123，45", 123.45, 12345.0), ("¥123.45", 123.45, 123.45), ("1,500.00", None, 1500.0), (None, None, None), ("", None, None), ("abc", None, None), ("-10", -10.0, -10.0)])
def test_numbers(spark, cell, imp, ext):
    assert one(spark, N.import_number, cell) == imp and one(spark, N.extraction_number, cell) == ext


@pytest.mark.parametrize(
    "name,want",
    [("Φ108 热浸镀锌钢管", "DN100 热浸镀锌钢管"), ("4寸镀锌钢管", "DN100镀锌钢管"), ("1/2寸管", "DN15管"), ("100mm 无缝钢管", "DN100 无缝钢管"), ("DN100 热浸镀锌钢管", "DN100 热浸镀锌钢管"), ("桥架 300*150", "桥架 300×150"),
     ("桥架 300x150", "桥架 300×150"), ("蝶型阀 DN100", "蝶阀 DN100"), ("逆止阀", "止回阀"), ("风盘 FP-68", "风机盘管 FP-68"), ("母线槽 1000A", "母线槽 1000A"), ("线槽", "槽式桥架"), ("Φ999", "Φ999"), ("ＤＮ５０ 阀门", "DN50 阀门"),
     ("dn50\t阀门\n", "DN50 阀门"), ("DN50　阀门​", "DN50 阀门"), ("", ""), (None, None), ("   ", "   ")],
)
def test_standard_names(spark, name, want):
    got = one(spark, T.standardised, name)
    assert got.standardized == want
    if want and want.strip():
        assert one(spark, T.standardised, want).standardized == want  # once is enough


@pytest.mark.parametrize("name,want", [("止回阀门 DN50", []), ("阀门 DN100", ["阀门"]), ("DN100 阀门", ["阀门"]), ("低压母线槽 1000A", ["母线槽"]), ("桥架", ["桥架"]), ("xyz", [])])
def test_category_inference(spark, name, want):
    assert one(spark, T.categories_in, name) == want


def test_sub_categories_brands_dates(spark):
    sub = lambda n, c: one(spark, lambda x: T.sub_category(x, F.lit(c)), n)
    assert [sub("梯式桥架 300", "桥架"), sub("蝶阀", "阀门"), sub("y型过滤器", "阀门"), sub("x", "阀门"), sub(None, "阀门")] == ["梯式桥架", "蝶阀", "过滤器", "其他", "未分类"]
    assert [one(spark, T.clean_brand, b) for b in (" 良 工　", "12.5", "", None)] == ["良工", None, None, None]
    assert one(spark, T.dates_in, "报价2025.1.3，2025/10/12") == ["2025.1.3", "2025/10/12"]
    assert one(spark, T.tolerant_json, '<think>x</think>```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'


def bid_frames(spark):
    quotes = spark.createDataFrame([(1, 1, 1, 1, 720.0, 10.0, "良工", "2025-01-02", ""), (2, 2, 1, 1, 380.0, 20.0, "良工", "", ""), (3, 1, 2, 1, 690.0, 10.0, "正丰", "", ""), (4, 2, 2, 1, 400.0, 20.0, "正丰", "2025-03-01", ""), (5, 1, 2, 1, 700.0, 0.0, "正丰", "", "")], QUOTE)
    materials = spark.createDataFrame([(1, "DN100 闸阀", "阀门", "", "Z45", "给排水", None, None), (2, "DN50 闸阀", "阀门", "", None, "给排水", None, None)], MATERIAL)
    suppliers = spark.createDataFrame([(1, "A"), (2, "B")], "id long, name string")
    bounds = spark.createDataFrame([("default", 0.05, 0.10)], "category string, yellow double, red double")
    return B.valid(quotes, materials), suppliers, bounds


def test_matrix_of_two_suppliers(spark):
    valid, suppliers, bounds = bid_frames(spark)
    cells = M.matrix(valid, suppliers, bounds, [2, 1, 99], category="阀门")
    rows = {(r.material_id, r.supplier_id): r for r in cells.collect()}
    assert len(rows) == 6 and rows[1, 99].price is None and rows[1, 99].label is None and rows[1, 99].alert_level == "normal"
    assert rows[1, 2].price == 700.0 and rows[1, 2].total == 700.0 and rows[1, 2].is_lowest and rows[1, 2].recommended == "A"
    assert rows[2, 1].is_lowest and rows[2, 1].recommended == "B" and not rows[2, 2].is_lowest and rows[2, 1].min_deviation == 0.0
    assert (rows[1, 2].period, rows[1, 2].projects, rows[1, 2].historical_avg, rows[1, 2].tier_filter) == ("2025-01-02~2025-03-01", 1, 578.0, None)
    assert {r.supplier_id: (r.quoted, r.rows) for r in M.totals(cells).collect()} == {1: (2, 2), 2: (2, 2), 99: (0, 2)}
    assert len(M.nested(cells).collect()) == 2 and M.wide(cells, ["A", "B"]).count() == 3
    lines = [r.line for r in M.as_text(cells).orderBy("line_no").collect()]
    assert lines == ["DN100 闸阀 (Z45) | ¥578 | ¥700 +84.2% ★ | ¥720 +89.5% | 未报价", "DN50 闸阀 | ¥578 | ¥400 +5.3% | ¥380 +0.0% ★ | 未报价"]
    assert len(M.as_text(cells, most=1).collect()) == 2
    assert M.matrix(valid, suppliers, bounds, [98]).count() == 0


def test_matrix_with_aligned_rows(spark):
    valid, suppliers, bounds = bid_frames(spark)
    groups = spark.createDataFrame([(1, 1, "阀门", "闸阀 DN100", "Z45X", "confirmed"), (2, 1, "阀门", "x", "", "suggested")], "id long, project_id long, category string, suggested_name string, suggested_spec string, status string")
    items = spark.createDataFrame([(1, 1, 1, 1, "align"), (2, 1, 5, 2, "align"), (3, 1, 3, 2, "align"), (4, 1, 2, 1, "ignore"), (5, 2, 4, 2, "align")], "id long, group_id long, quote_id long, supplier_id long, action string")
    got = M.matrix(valid, suppliers, bounds, [1, 2], project_id=1, category="阀门", groups=groups, items=items).collect()
    cells = {(r.group_id, r.material_id, r.supplier_id): r for r in got}
    # The later item of a supplier wins; the quotes of the group leave their material's row, and quote 3 takes no one's place.
    assert cells.keys() == {(1, 1, 1), (1, 1, 2), (None, 2, 1), (None, 2, 2)}
    assert cells[1, 1, 2].price == 690.0 and cells[1, 1, 1].material == "闸阀 DN100" and cells[1, 1, 1].spec == "Z45X" and cells[1, 1, 2].is_lowest
    plain = M.matrix(valid, suppliers, bounds, [1, 2], project_id=1, groups=groups, items=items)
    assert {r.group_id for r in plain.collect()} == {None}  # not without a category


@pytest.mark.parametrize("tiers,want", [(["合资", "", None], True), (["合资", "国产"], False), ([None], False), ([], False)])
def test_lone_supplier_of_joint_ventures(spark, tiers, want):
    assert M.only_joint_venture(spark.createDataFrame([(t,) for t in tiers], "tier string")).first().jv is want


def test_lone_supplier_is_measured_by_its_tier(spark):
    valid, suppliers, bounds = bid_frames(spark)
    tiers = spark.createDataFrame([("正丰", "合资", None), ("良工", "国产", None)], "brand_name string, tier string, category string")
    rows = {r.material_id: r for r in M.matrix(B.with_tier(valid, tiers), suppliers, bounds, [2], category="阀门").collect()}
    assert {(r.reference, r.tier_filter) for r in rows.values()} == {(400.0, "合资")}
    rows = M.matrix(B.with_tier(valid, tiers), suppliers, bounds, [1], category="阀门").collect()
    assert {(r.reference, r.tier_filter) for r in rows} == {(380.0, None)}


def test_weights_are_checked():
    assert checked_weights({"price_competitiveness": 0.41})["price_competitiveness"] == 0.41
    with pytest.raises(ValueError):
        checked_weights({"price_competitiveness": 0.9})


def test_pages_codes_upserts(spark):
    rows = spark.range(25)
    assert [r.id for r in C.page(rows, ["id"], 2, 10).collect()] == list(range(10, 20))
    with pytest.raises(ValueError):
        C.page(rows, ["id"], 0)
    new = spark.createDataFrame([("EL-BRG", "a"), ("EL-BRG", "b"), ("WS-VLV", "c")], "prefix string, name string")
    used = spark.createDataFrame([("EL-BRG-00005",), ("EL-BRG-99999",)], "material_code string")
    assert {r.name: r.material_code for r in C.coded(new, used).collect()} == {"a": "EL-BRG-100000", "b": "EL-BRG-100001", "c": "WS-VLV-00001"}
    table = spark.createDataFrame([("a", None, 1), ("a", "x", 2)], "brand string, category string, tier int")
    got = C.upserted(table, spark.createDataFrame([("a", None, 9), ("b", "x", 8)], table.schema), ["brand", "category"])
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "x", 2), ("a", None, 9), ("b", "x", 8)]
    assert {r.name for r in C.filtered(spark.createDataFrame([("Ab",), ("xa",), ("c",), (None,)], "name string"), keyword="A", keyword_columns=("name",)).collect()} == {"Ab", "xa"}


def test_column_detection():
    at = I.detected_columns(["名称", "规格型号", "品牌", "单位", "不含税单价", "数量", "备注"])
    assert at["name"] == "名称" and at["spec"] == "规格型号" and at["price"] == at["price_excl"] == "不含税单价" and at["supplier"] is None


def test_import_resolves_dimensions(spark):
    sheet = spark.createDataFrame([(1, "闸阀", "Z45", "良工", "120", "10"), (2, " ", None, None, None, None), (3, "闸阀", None, "正丰", "abc", "-1"), (4, "新阀", None, "甲", "1,5", "2"), (5, "新阀", "Q1", "甲", "9", "2")], "line_no long, `名称` string, `规格型号` string, `品牌` string, `含税单价` string, `数量` string")
    materials = spark.createDataFrame([(7, "阀门", "闸阀", "Z45"), (6, "阀门", "闸阀", "X")], "id long, category string, standard_name string, spec string")
    suppliers = spark.createDataFrame([(3, "良工")], "id long, name string")
    tiers = spark.createDataFrame([("良工", "合资", None)], "brand_name string, tier string, category string")
    quotes, new, summary = I.imported(sheet, materials, suppliers, tiers, "阀门", "IMP-1", default_supplier_id=3, project_id=9)
    got = {r.line_no: r for r in quotes.collect()}
    assert (got[1].material_id, got[1].supplier_id, got[1].total_price, got[1].brand_tier, got[1].project_id) == (7, 3, 1200.0, "合资", 9)
    assert (got[3].material_id, got[3].unit_price, got[3].quantity) == (6, None, None)
    assert (got[4].new_from_line, got[4].unit_price) == (4, 1.5) and got[5].new_from_line == 5
    assert {(r.standard_name, r.spec, r.profession) for r in new.collect()} == {("新阀", "", "给排水"), ("新阀", "Q1", "给排水")}
    s = summary.first()
    assert (s.status, s.imported, s.skipped, s.unknown_brands, s.supplier_ids, [e.row for e in s["errors"]]) == ("ok", 4, 1, ["正丰", "甲"], [3], [5])
    with pytest.raises(ValueError):
        I.imported(sheet, materials, suppliers, tiers, "no category", "IMP-1")


def test_import_takes_suppliers_from_their_column(spark):
    sheet = spark.createDataFrame([(1, "闸阀", "良工", " 甲公司 ", "5"), (2, "闸阀", "良工", None, "5")], "line_no long, `名称` string, `品牌` string, `供应商` string, `含税单价` string")
    materials = spark.createDataFrame([], "id long, category string, standard_name string, spec string")
    suppliers = spark.createDataFrame([(3, "良工")], "id long, name string")
    tiers = spark.createDataFrame([], "brand_name string, tier string, category string")
    quotes, _, _ = I.imported(sheet, materials, suppliers, tiers, "阀门", "IMP-1")
    assert {r.line_no: r.supplier_id for r in quotes.collect()} == {1: 4, 2: None}


def test_page_results_merge(spark):
    page = lambda supplier, *items: f'{{"supplier_name": "{supplier}", "items": [' + ", ".join(f'{{"material": "{m}", "qty": "{q}", "unit_price": "{p}"}}' for m, q, p in items) + "]}"
    rows = [("d", 1, page("", ("阀", "2", "1,500.00"), ("", "1", "1")), 0.9, 100, 400), ("d", 2, page("甲", ("管", "3", "5"), ("阀", "2", "1500")), 0.6, 200, 600), ("d", 3, None, 0.8, 0, 0)]
    doc = E.merged(spark.createDataFrame(rows, "doc_id string, page int, data string, confidence double, tokens_used long, duration_ms long"))
    row = doc.first()
    assert (row.supplier_name, row.tokens_used, row.duration_ms, row.confidence, len(row["items"])) == ("甲", 300, 1000, 0.6, 3)
    got = E.lines(doc).orderBy("pos").collect()
    assert [(r.material, r.qty, r.unit_price, r.total_price) for r in got] == [("阀", 2.0, 1500.0, 3000.0), ("管", 3.0, 5.0, 15.0)]
    assert list(row.items_per_page) == [2, 2, 0]


def test_tenders_merge_too(spark):
    page = '{{"project_name": "{}", "deadline": "d{}", "items": [{{"name": "阀", "spec": "x", "quantity": "{}"}}]}}'.format
    rows = [("t", 2, page("", 2, 1), 0.5, 1, 1, "two"), ("t", 1, page("P", "", 1), None, 2, 2, "one"), ("t", 3, page("Q", 3, 7), 0.7, 0, 0, "")]
    row = E.merged(spark.createDataFrame(rows, "doc_id string, page int, data string, confidence double, tokens_used long, duration_ms long, raw_text string"), "tender").first()
    assert (row.project_name, row.deadline, row.confidence, [i.quantity for i in row["items"]], row.raw_text) == ("P", "d", 0.5, ["1", "7"], "one\n---batch---\ntwo")


@pytest.mark.parametrize("price,qty,total,want", [(1802.0, 17.0, 1802.0, ("unit_is_total", 106.0)), (100.0, 1.0, 100.0, None), (100.0, 2.0, 200.0, None), (300.0, 3.0, None, ("swap_total_to_unit", 100.0)), (301.5, 4.0, None, ("swap_total_to_unit", 75.38)), (7.0, 4.0, None, None), (None, 4.0, None, None), (5.0, None, 5.0, None)])
def test_suggested_prices(spark, price, qty, total, want):
    row = spark.createDataFrame([(price, qty, total)], "p double, q double, t double").select(N.suggested_price(F.col("p"), F.col("q"), F.col("t")).alias("s")).first().s
    assert (tuple(row) if row else None) == want


def test_confirmed_lines_become_quotes_once(spark):
    lines = spark.createDataFrame([("job12345678", 0, "Φ108 闸阀", "Z", "良工", "个", 2.0, 110.0, None, "r" * 600), ("job12345678", 1, " ", "", None, None, 1.0, 1.0, None, None), ("job12345678", 2, "新阀", None, "甲", "个", 1.0, 5.0, 6.0, None)], "job_id string, pos int, material string, spec string, brand string, unit string, qty double, unit_price double, total_price double, remark string")
    materials = spark.createDataFrame([(7, "阀门", "DN100 闸阀", "Z", 0.0, 100.0)], "id long, category string, standard_name string, spec string, ref_price_reasonable_low double, ref_price_median double")
    bounds = spark.createDataFrame([("default", 0.05, 0.10)], "category string, yellow double, red double")
    tiers = spark.createDataFrame([("良工", "合资", "桥架")], "brand_name string, tier string, category string")
    none = spark.createDataFrame([], "batch_id string")
    quotes, fresh, unknown = E.confirmed(lines, materials, bounds, none, tiers, "阀门", supplier_id=4)
    got = {r.standard_name: r for r in quotes.collect()}
    old, new = got["DN100 闸阀"], got["新阀"]
    assert (old.material_id, old.total_price, old.brand_tier, old.deviation_pct, old.alert_level, len(old.remark), old.batch_id) == (7, 220.0, "合资", 0.1, "yellow", 500, "OCR-job12345-4")
    assert (new.material_id, new.total_price, new.brand_tier, new.alert_level) == (None, 6.0, "", "") and len(got) == 2
    assert [r.standard_name for r in fresh.collect()] == ["新阀"] and [r.brand for r in unknown.collect()] == ["甲"]
    done = spark.createDataFrame([("OCR-job12345-4",)], "batch_id string")
    assert E.confirmed(lines, materials, bounds, done, tiers, "阀门", supplier_id=4)[0].count() == 0


def test_alignment_responses(spark):
    good = '```json\n{"groups": [{"suggested_name": "n", "items": [{"quote_id": 1, "supplier_id": 2, "action": "align"}], "confidence": "0.9"}, {"items": []}], "field_fixes": [{"quote_id": "7", "suggested": 1.5}, {"field": "x"}]}\n```'
    rows = {r.id: r for r in E.alignment_response(spark.createDataFrame([(1, good), (2, "no JSON"), (3, None)], "id long, reply string")).collect()}
    g = rows[1].groups[0]
    assert (rows[1].n_groups, g.suggested_name, g.suggested_spec, g.confidence, g["items"][0].quote_id) == (1, "n", "", 0.9, 1)
    assert [(f.quote_id, f.field, f.suggested) for f in rows[1].field_fixes] == [(7, "unit_price", 1.5)] and (rows[2].n_groups, rows[3].n_fixes) == (0, 0)


def test_alignment_is_applied_and_undone(spark):
    groups = spark.createDataFrame([(1, "confirmed"), (2, "rejected")], "id long, status string")
    items = spark.createDataFrame([(1, 1, 5), (2, 2, 6)], "id long, group_id long, quote_id long")
    fixes = spark.createDataFrame([(5, "unit_price", 9.0), (6, "quantity", 1.0), (7, "unit_price", None)], "quote_id long, field string, new_value double")
    quotes = spark.createDataFrame([(5, 90.0, 900.0), (6, 1.0, 1.0), (7, 2.0, 2.0)], "id long, unit_price double, total_price double")
    live, inside, fixed = C.applied_alignment(groups, items, fixes, quotes)
    assert [r.id for r in live.collect()] == [1] and [r.id for r in inside.collect()] == [1]
    assert sorted(map(tuple, fixed.collect())) == [(5, 9.0, 900.0), (6, 1.0, 1.0), (7, 2.0, 2.0)]  # derived columns stay
    a, b = C.without_group(groups, items, 1)
    assert [r.id for r in a.collect()] == [2] and [r.id for r in b.collect()] == [2]
    assert [r.id for r in C.without(quotes, "id", 5).orderBy("id").collect()] == [6, 7]


def test_names_match_by_containment(spark):
    suppliers = spark.createDataFrame([(4, "上海良工阀门厂"), (2, "正 丰"), (3, "甲"), (9, "ABC Co"), (8, "abcco")], "id long, name string")
    names = spark.createDataFrame([("良工阀门",), ("正丰",), ("上海良工阀门厂有限公司",), ("abc CO",), ("甲乙",), ("无",), ("",), (None,)], "name string")
    assert {r.name: r.supplier_id for r in C.matched_suppliers(names, suppliers).collect()} == {"良工阀门": 4, "正丰": 2, "上海良工阀门厂有限公司": 4, "abc CO": 8, "甲乙": 3}


def test_invitations_and_tenders(spark):
    suppliers = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    best = spark.createDataFrame([(2, 1, 80.0)], "supplier_id long, rank int, score double")
    before = spark.createDataFrame([(7, 1, 5, 50.0, "sent")], "tender_id long, supplier_id long, rank int, score double, status string")
    got = {r.supplier_id: (r.rank, r.score, r.status) for r in C.invited([1, 2, 3, 99], suppliers, best, 7, before).collect()}
    assert got == {1: (5, 50.0, "sent"), 2: (1, 80.0, "pending"), 3: (None, None, "pending")}
    tenders = spark.createDataFrame([(7, "p", "draft", ["x", "y"], 2), (8, "q", "draft", None, 1)], "id long, project_name string, status string, items array<string>, created_at long")
    assert {r.id: r.status for r in C.tenders_after(tenders, before).collect()} == {7: "invited", 8: "draft"}
    assert [(r.id, r.item_count, r.invitation_count) for r in C.tenders_listed(tenders, before).orderBy("id").collect()] == [(7, 2, 1), (8, 0, 0)]
    nested = C.with_children(tenders.drop("items"), before, "tender_id", ["supplier_id", "rank", "status"]).orderBy("id").collect()
    assert [r.n_items for r in nested] == [1, 0]


def test_many_names_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "NAMES", 7)
    names = spark.createDataFrame([(f"n{i:03d}",) for i in range(60)] + [("n001 ",), (" ",), (None,)], "name string")
    got = {r.name: r.id for r in C.get_or_create(names, spark.createDataFrame([(100, "n005")], "id long, name string")).collect()}
    assert got == {f"n{i:03d}": 100 if i == 5 else 101 + i - (i > 5) for i in range(60)}


def test_sufficiency_points(spark):
    rows = [("a", 5, 3, 100, 0.0), ("b", 3, 2, 30, 10.0), ("c", 0, 0, 5, 50.0), ("d", 1, 1, 10, 30.0)]
    got = {r.category: r for r in D.sufficiency(spark.createDataFrame(rows, "category string, n_projects int, n_brands int, n_valid_price int, price_missing_pct double")).collect()}
    assert {c: (r.score, r.verdict, r.round1, r.round2, r.round3) for c, r in got.items()} == {
        "a": (11, "✅ 可支撑比价", "✅", "✅", "✅"), "b": (7, "⚠️ 勉强支撑", "✅", "⚠️", "⚠️"), "c": (2, "⚠️ 勉强支撑（无品牌数据）", "❌", "❌", "❌"), "d": (3, "❌ 不足以支撑", "⚠️", "❌", "❌")}
    assert got["b"].notes == ["项目覆盖一般(3个)", "供应商偏少(2家)", "有效价格数据一般(30条)", "价格缺失率10.0%"]


def test_scores_without_references(spark):
    """No deviation scores 60; brands count whether they are priced or not; two suppliers, one material."""
    quotes, materials = frames(spark, [10.0, None])
    suppliers = spark.createDataFrame([(1, "A", 3, 75.0), (2, "B", 0, 0.0)], "id long, name string, win_count int, cooperation_score double")
    quotes = quotes.withColumn("brand", F.when(F.col("unit_price").isNull(), "x").otherwise("y")).withColumn("category", F.lit("桥架"))
    tiers = spark.createDataFrame([("x", "合资", None)], "brand_name string, tier string, category string")
    valid = B.valid(quotes.drop("category"), materials).withColumn("ref_price_median", F.lit(None).cast("double"))
    got = {r.supplier_id: r for r in S.score(suppliers, quotes, valid, tiers).collect()}
    assert (got[1].price_score, got[1].history_score, got[1].completeness_score, got[1].brand_score, got[1].commercial_score, got[1].total_score) == (60.0, 80.0, 50.0, 50.0, 75.0, 62.5)
    assert (got[2].price_score, got[2].history_score, got[2].completeness_score, got[2].brand_score, got[2].commercial_score) == (60.0, 40.0, 50.0, 70.0, 60.0)
    row = S.compare([2, 1, 5], suppliers, quotes, valid, tiers, "桥架").orderBy("position").collect()
    assert [(r.position, r.supplier_id, r.quote_count, r.completeness) for r in row] == [(1, 2, 0, 0.0), (2, 1, 1, 0.5)]


def test_recommendation_fills_up_with_newcomers(spark):
    quotes, materials = frames(spark, [10.0, 12.0])
    quotes = quotes.withColumn("quote_date", F.lit("2025-01-01"))
    suppliers = spark.createDataFrame([(i, f"s{i}", 0, 0.0) for i in range(1, 5)], "id long, name string, win_count int, cooperation_score double")
    tiers = spark.createDataFrame([], "brand_name string, tier string, category string")
    valid, every = B.valid(quotes, materials), quotes.withColumn("category", F.lit("桥架"))
    best = lambda categories, n: [(r.rank, r.supplier_id, r.history_count) for r in R.recommend(suppliers, every, valid, tiers, categories, n, "2025-02-01").orderBy("rank").collect()]
    assert best(["桥架"], 3) == [(1, 1, 2), (2, 2, 0), (3, 3, 0)]
    assert best(["阀门"], 2)[0] == (1, 1, 2)  # a newcomer there is scored with its whole history
    assert {s for _, s, _ in best([], 4)} == {1, 2, 3, 4} and best(["桥架"], 0) == best(["桥架"], -1) == []


def test_file_statistics(spark):
    rows = spark.createDataFrame([("阀门", "蝶阀 DN50", 10.0, " 良 工", "报价2025.10.3"), ("阀门", "蝶阀", None, "12", "2025.2.1"), ("阀门", "不知", -1.0, None, None)], "category string, name string, price double, brand string, remark string")
    r = D.file_statistics(rows).first()
    assert (r.n_total, r.n_valid_price, r.price_missing_pct, r.brands, r.dates, r.sub_categories) == (3, 1, 66.7, ["良工"], ["2025.2.1", "2025.10.3"], ["蝶阀 2", "其他 1"])


def test_small_texts_and_checks(spark):
    assert [one(spark, N.percent, x, "double") for x in (0.05, -0.032, None)] == ["+5.0%", "-3.2%", "—"]
    assert [one(spark, N.folded_alert, x) for x in ("blue", "green", "yellow", "red", None)] == ["red", "normal", "yellow", "red", "normal"]
    assert one(spark, T.standardised, "桥架 300 * 150mm").standardized == "桥架 300×150MM"
    context = lambda m: spark.createDataFrame([(m,)], "c map<string,string>").select(E.context_hash(F.col("c")).alias("h")).first().h
    assert context({"project_id": "1", "category": "x"}) == context({"category": "x", "project_id": "1", "other": "y"}) != context({"category": "x"})
    assert context({}) == context({"other": "y"}) == context({"category": ""}) == context(None) == "noctx"
    assert S.checked_thresholds({"a": (0.05, 0.1)})
    with pytest.raises(ValueError):
        S.checked_thresholds({"a": (0.1, 0.1)})
    config = spark.createDataFrame([("k", "1")], "key string, value string")
    assert S.config_value(config, "k") == "1" and S.config_value(config, "x", "d") == "d"
    attributes, naming = C.constants(spark)
    assert attributes.filter("category = '阀门'").count() == 4 and naming.filter("part = '表面处理'").count() == 6
    cards = D.supplier_cards(spark.createDataFrame([(90, "2026-01", 5), (None, None, 1)], "ai_score int, last_cooperation string, win_count int"), "2026").first()
    assert tuple(cards) == (2, 1, 1, 1)


def test_failed_pages_stop_nothing(spark):
    def provider(text):
        if text == "bad":
            raise ValueError("no page")
        return text, 1.0, 1, 1

    pages = spark.createDataFrame([("d", 1, "{}"), ("d", 2, "bad")], "doc_id string, page int, content string")
    assert {(r.page, r.error) for r in E.pages_read(pages, provider).collect()} == {(1, None), (2, "no page")}


def test_jobs(spark):
    jobs = spark.createDataFrame([(1, "h", "quote", "c", "done", "2024-01-01 00:00:00"), (2, "h", "quote", "c", "failed", "2024-01-02 00:00:00"), (3, "h", "quote", "d", "running", "2024-01-02 00:00:00")], "id long, file_hash string, type string, context string, status string, created_at string")
    jobs = jobs.withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("created_at"))
    assert {r.id for r in E.latest_job(jobs).collect()} == {1, 3}
    assert {r.id: r.status for r in E.swept(jobs, "2024-01-02 00:10:00").collect()} == {1: "done", 2: "failed", 3: "failed"}
    assert {r.id: r.status for r in E.swept(jobs, "2024-01-02 00:04:00").collect()}[3] == "running"
    assert one(spark, lambda x: E.page_batches(F.split(x, ","), 2), "a,b,c,d,e") == [["a", "b"], ["a", "c", "d"], ["a", "e"]]


def test_nested_treemap(spark):
    rows = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 3.0), ("q", "a", 2.0)], "project string, category string, value double")
    got = {r.project: r for r in D.nested(rows, "project", "category").collect()}
    assert got["p"].value == 4.0 and [c["name"] for c in got["p"].children] == ["b", "a"]
