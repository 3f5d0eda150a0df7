import io
import random
import re
import tracemalloc
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from bidloom.sources import files, sinks


def test_category_files(spark, tmp_path):
    head = "序号,名称,规格,材质,侧板厚度,底板厚度,盖板厚度,数量,单位,本体单价含税,盖板,合价,合计,品牌,标准,备注"
    (tmp_path / "a.csv").write_text("﻿" + head + "\n1,桥架,300*150,钢,1,1,1,10,m,45.5,,,,\"甲,乙\",,\n合计,,,,,,,,,,,,,,,\n2,桥架,200*100,钢,1,1,1,5,m,\"30,5\",,,,12,,\n", encoding="utf-8")
    rows = files.category_rows(files.raw_lines(spark, str(tmp_path / "a.csv")), "桥架").orderBy("line_no").collect()
    assert [(r.name, r.spec, r.brand, r.quantity, r.price) for r in rows] == [("桥架", "300*150", "甲,乙", 10.0, 45.5), ("桥架", "200*100", None, 5.0, 30.5)]
    valve = ["x", "y", "z", ",".join(["1", "水", "闸阀", "DN100", "Z", *[""] * 6, "个", "4", "", "", "", "", "100", "良工", ""])]
    (tmp_path / "b.csv").write_text("\n".join(valve), encoding="utf-8")
    (row,) = files.category_rows(files.raw_lines(spark, str(tmp_path / "b.csv")), "阀门").collect()
    assert (row.name, row.price, row.brand) == ("闸阀", 25.0, "良工")
    pump = ["h", "h", "泵,100,1,2,,5,extra,3,13%,900,2700,格兰富,备注"]
    (tmp_path / "c.csv").write_text("\n".join(pump), encoding="utf-8")
    (row,) = files.category_rows(files.raw_lines(spark, str(tmp_path / "c.csv")), "空调泵").collect()
    assert (row.name, row.quantity, row.price, row.brand) == ("泵", 3.0, 900.0, "格兰富")
    box = ["1-1,AL1,照明箱", "断路器,1,2,30", "单台合计,,,¥1200.5,9", "总计,,,0,", "2-3,AL2,动力箱", "小计,,,5", ",总计,,,88"]
    (tmp_path / "d.csv").write_text("\n".join(box), encoding="utf-8")
    got = files.box_totals(files.raw_lines(spark, str(tmp_path / "d.csv"))).orderBy("line_no").collect()
    assert [(r.box, r.price) for r in got] == [("AL1 照明箱", 1200.5), ("AL2 动力箱", 88.0)]


def test_csv_with_mark_and_manifest(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿名称,含税单价\n阀,1\n", encoding="utf-8")
    assert files.csv_sheet(spark, str(tmp_path / "s.csv")).columns == ["名称", "含税单价"]
    (tmp_path / "m.json").write_text('[{"csv": "a", "sheet": "汇总", "category": "阀门", "rows": 3}, {"csv": "b", "sheet": "一期", "category": "阀门", "rows": 9}, {"csv": "c", "sheet": "投标参数", "category": "水箱", "rows": 2}, {"csv": "d", "sheet": "二期 ", "category": "水箱", "rows": 5}]', encoding="utf-8")
    m = files.manifest(spark, str(tmp_path / "m.json"))
    assert {r.csv for r in files.summary_sheets(m).collect()} == {"a", "d"}
    assert {r.name for r in files.project_names(m).collect()} == {"一期", "二期"}


def test_workbooks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("闸阀 <1>", 2.5, ["a", "b"]), (None, None, None)], "name string, price double, tags array<string>")
    sinks.xlsx({"一": df, "二": df.limit(1)}, str(tmp_path / "w.xlsx"))
    rows = files.workbook_rows(files.raw_documents(spark, str(tmp_path / "w.xlsx"))).orderBy("sheet", "line_no").collect()
    assert [(r.sheet, r.cells) for r in rows][:2] == [("一", ["name", "price", "tags"]), ("一", ["闸阀 <1>", "2.5", "a, b"])]
    spark.dataSource.register(files.XlsxSource)
    assert spark.read.format("xlsx").load(str(tmp_path / "*.xlsx")).count() == len(rows)
    assert "price" in sinks.log_lines(df).first().value


def test_sinks(spark, tmp_path):
    df = spark.range(5).withColumn("k", F.col("id") % 2)
    sinks.overwritten(df, f"{tmp_path}/p", ["k"])
    sinks.overwritten(df, f"{tmp_path}/p", ["k"])
    sinks.csv(df, f"{tmp_path}/c")
    assert spark.read.parquet(f"{tmp_path}/p").count() == spark.read.csv(f"{tmp_path}/c", header=True).count() == 5


def by_pandas(text):
    """The rows that pandas reads, without empty cells at their end."""
    rows = pd.read_csv(io.StringIO(text.removeprefix("\ufeff")), header=None, dtype=str, keep_default_na=False, names=range(12), index_col=False).values.tolist()
    return [re.sub(",+$", "", ",".join(map(repr, r)).replace("''", "")) for r in rows]


def read_rows(spark, path):
    rows = sorted(files.raw_lines(spark, str(path)).collect(), key=lambda r: r.line_no)
    assert [r.line_no for r in rows] == list(range(len(rows)))
    return [re.sub(",+$", "", ",".join(map(repr, r.cells)).replace("''", "")) for r in rows]


@pytest.fixture
def small_splits(spark):
    """Files are cut after 40 bytes."""
    for k, v in {"spark.sql.files.maxPartitionBytes": "40b", "spark.sql.files.openCostInBytes": "0"}.items():
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(k)


TEXTS = ['a,b\n\n  \n1,2\n', '\ufeff"a\nb",c\n \t \n,,\n""\n3,4', 'a,b\n"x\ny",2\n4" pipe,3\n5,"a"b"c\n', '"a""\nb",c\n\n"q\n\n\nr",d\n', "x," + "y" * 300 + '\n"' + "line\n" * 60 + '",end\nlast,1\n']


@pytest.mark.parametrize("seed", range(len(TEXTS) + 14))
def test_records_over_lines_and_splits(spark, tmp_path, small_splits, seed):
    rng, text, want = random.Random(seed), TEXTS[seed] if seed < len(TEXTS) else "", None
    while want is None:
        text = text or "".join(rng.choice('aab,,"""\n\n ') for _ in range(400)) + "\n"
        try:
            want = by_pandas(text)
        except Exception:  # a quote that is never closed, or more cells than any
            text = ""
    (tmp_path / "a.csv").write_text(text, encoding="utf-8")
    assert read_rows(spark, tmp_path / "a.csv") == want


def test_splits_beyond_the_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(files, "MOST_SPLITS", 1)
    (tmp_path / "a.csv").write_text(TEXTS[4], encoding="utf-8")
    (tmp_path / "b.csv").write_text(TEXTS[3], encoding="utf-8")
    got = files.raw_lines(spark, str(tmp_path)).collect()
    assert sorted(len(r.cells) for r in got) == [2] * 5 and max(len(c) for r in got for c in r.cells) == 300


def test_a_name_over_two_lines(spark, tmp_path):
    (tmp_path / "p.csv").write_text('序号,名称\n\n1,"排水\n潜水泵",WQ,,,,,2,,450,,"格兰\n富"\n', encoding="utf-8")
    (row,) = files.category_rows(files.raw_lines(spark, str(tmp_path)), "潜水泵").collect()
    assert (row.name, row.quantity, row.price, row.brand, row.line_no) == ("排水\n潜水泵", 2.0, 450.0, "格兰\n富", 1)


def big_workbook(path, rows):
    """Two sheets of many rows with their texts in a shared table, as spreadsheets write them."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="一" sheetId="1" r:id="r1"/><sheet name="二" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{rel}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in (1, 2)) + "</Relationships>")
        with z.open("xl/sharedStrings.xml", "w") as f:
            f.write(f"<sst {ns}>".encode())
            for k in range(rows):
                f.write(f"<si><r><t>text </t></r><r><t>{k} {'x' * 40}</t></r><rPh><t>no</t></rPh></si>".encode())
            f.write(b"</sst>")
        for sheet in (1, 2):
            with z.open(f"xl/worksheets/sheet{sheet}.xml", "w") as f:
                f.write(f"<worksheet {ns}><sheetData>".encode())
                for k in range(rows):
                    f.write(f'<row r="{k + 1}"><c r="A{k + 1}"><v>{k}</v></c><c r="C{k + 1}" t="s"><v>{k}</v></c></row>'.encode())
                f.write(b"</sheetData></worksheet>")


def test_sheets_stream_through_little_memory(spark, tmp_path):
    """Every sheet is a partition; a task holds neither a sheet's tree nor the texts."""
    path, rows = str(tmp_path / "big.xlsx"), 60_000
    big_workbook(path, rows)
    reader = files._Reader(files._listed(path))
    sheets = reader.partitions()
    assert [s.sheet for s in sheets] == ["一", "二"]
    tracemalloc.start()
    n, last = 0, None
    for last in reader.read(sheets[1]):
        n += 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == rows and last == (path, "二", rows - 1, [str(rows - 1), None, f"text {rows - 1} {'x' * 40}"])
    assert peak < 8e6, peak  # the sheet's tree alone takes ten times as much
    spark.dataSource.register(files.XlsxSource)
    df = spark.read.format("xlsx").load(f"{tmp_path}/*.xlsx")
    assert df.rdd.getNumPartitions() == 2 and df.groupBy("sheet").count().collect()[0]["count"] == rows
    assert files._listed(str(tmp_path)) == files._listed(f"{tmp_path}/b*.xlsx") == [path]
    assert files._listed(f"file://{tmp_path}/*.xlsx") == [f"file://{path}"]


def test_workbooks_fan_out_to_folders_with_a_manifest(spark, tmp_path):
    df = spark.createDataFrame([("闸阀", 2.5), ("蝶阀", None)], "name string, price double")
    sinks.xlsx({"汇总": df, "一期": df.limit(1)}, str(tmp_path / "阀门询价格式.xlsx"))
    rows = files.workbook_rows(files.raw_documents(spark, f"{tmp_path}/*.xlsx"))
    kinds = rows.select("path").distinct().selectExpr("path", "'给排水' AS profession", "'阀门' AS category")
    m = files.fanned_out(rows, f"{tmp_path}/out", kinds)
    got = {r.sheet: (r.csv, r.source_file, r.category, r.rows, r.cols) for r in m.collect()}
    assert got == {"汇总": ("阀门询价格式__汇总", "阀门询价格式.xlsx", "阀门", 3, 2), "一期": ("阀门询价格式__一期", "阀门询价格式.xlsx", "阀门", 2, 2)}
    assert spark.read.parquet(f"{tmp_path}/out/folder=阀门询价格式__汇总").count() == 3
    assert {r.csv for r in files.summary_sheets(m.select("csv", "source_file", "sheet", "profession", "category", "rows", "cols")).collect()} == {"阀门询价格式__汇总"}
    assert [(r.category, r.n_projects) for r in files.project_counts(m).collect()] == [("阀门", 1)]


LAYOUT_ROWS = {
    "风口风阀": (1, ["1", "百叶", "FK", "600×600", "1.0", "4", "个", "88.5", "354", "德州", "注"], ("百叶", "600×600", 4.0, 88.5, "德州", "个")),
    "母线槽": (1, ["2", "母线", "密集", "1000A", "", "", "", "", "西门子", "XL", "m", "12", "90", "13%", "101.7", "1220", ""], ("母线", "1000A", 12.0, 101.7, "西门子", "m")),
    "不锈钢管": (1, ["3", "管", "DN50", "2", "304", "卡压", "1.6", "m", "30", "50", "1500", "56.5", "1695", "金羊", ""], ("管", "DN50", 30.0, 56.5, "金羊", "m")),
    "水箱": (1, ["4", "水箱", "18t", "台", "2", "100", "200", "13%", "26", "226", "屋面", "北京", "304", ""], ("水箱", "18t", 2.0, 113.0, "北京", "台")),
    "潜水泵": (1, ["5", "泵", "WQ", "", "", "", "", "3", "", "450", "", "格兰富", ""], ("泵", "WQ", 3.0, 450.0, "格兰富", None)),
    "风机盘管": (1, ["6", "风盘", "FP-68", "", "", "7", "台", "", "", "", "", "700", "", "约克", ""], ("风盘", "FP-68", 7.0, 700.0, "约克", "台")),
}


@pytest.mark.parametrize("category", LAYOUT_ROWS)
def test_every_layout(spark, tmp_path, category):
    skip, cells, want = LAYOUT_ROWS[category]
    (tmp_path / "x.csv").write_text("\n".join(["9,head" + ",x" * 14] * skip + [",".join(cells), "合计" + "," * 14]), encoding="utf-8")
    (r,) = files.category_rows(files.raw_lines(spark, str(tmp_path)), category).collect()
    assert (r.name, r.spec, r.quantity, r.price, r.brand, r.unit) == want
