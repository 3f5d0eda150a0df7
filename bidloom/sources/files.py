"""Sheets and documents as DataFrames."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from array import array
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bidloom.functions.constants import CATEGORIES
from bidloom.functions.numbers import import_number

from .shared import saved

SHEET = "path string, sheet string, line_no int, cells array<string>"
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def csv_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A sheet with a header row, all strings."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True)


#: Splits of files whose starts are broadcast, at most.
MOST_SPLITS = 200_000
#: A field up to the next comma: one in quotes with what stands behind them, or a plain one.
FIELD = re.compile(r'"((?:[^"]|"")*+)("?)([^,]*)|([^,]*)')


def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at a physical line's end, if one was (``inside``) or was not at its start."""
    if '"' not in line:
        return inside
    at, start = 0, not inside
    while at <= len(line):
        if start:
            m = FIELD.match(line, at)
            if m[1] is not None and not m[2]:
                return True
            at = m.end() + 1
        else:
            m = FIELD.match('"' + line)
            if not m[2]:
                return True
            at, start = m.end(), True
    return False


def _blank(line: str) -> bool:
    return not line.strip(" \t")


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """Runs of lines of one split; the other columns as a tuple."""
    for batch in batches:
        names = [c for c in batch.schema.names if c != "value"]
        keys = list(zip(*[batch.column(c).to_pylist() for c in names]))
        values, at = batch.column("value").to_pylist(), 0
        while at < len(values):
            end = at + 1
            while end < len(values) and keys[end] == keys[at]:
                end += 1
            yield keys[at], values[at:end]
            at = end


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each split, if it begins outside and if it begins inside of quotes: how it ends and how many records begin in it."""
    found: dict[tuple, list] = {}
    for key, lines in _by_split(batches):
        if key not in found and key[1] == 0:
            lines[0] = lines[0].removeprefix("\ufeff")
        state = found.setdefault(key, [False, 0, True, 0])
        for k in (0, 2):
            inside, n = state[k], state[k + 1]
            for line in lines:
                n += not inside and not _blank(line)
                inside = open_after(line, inside)
            state[k], state[k + 1] = inside, n
    columns = list(zip(*[(*key, *state) for key, state in found.items()])) or [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "block", "plain_end", "plain_n", "quoted_end", "quoted_n"])


PIECE = "path string, line_no int, block long, whole boolean, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits whose starts are known; those that begin or end in another split as pieces."""
    split, out = None, []
    number, inside, record, crosses = 0, False, [], False

    def close(whole: bool) -> None:
        out.append((split[0], number, split[1], whole, "\n".join(record)))

    def batch() -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
        rows = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, kinds)]
        out.clear()
        return pa.RecordBatch.from_arrays(rows, names=["path", "line_no", "block", "whole", "text"])

    for (path, block, begins_inside, before), lines in _by_split(batches):
        if split != (path, block):
            if record:
                close(False)
            split, record, inside, crosses = (path, block), [], begins_inside, begins_inside
            number = before - 1
            lines = [lines[0].removeprefix("\ufeff"), *lines[1:]] if block == 0 else lines
        for line in lines:
            if not inside:
                if _blank(line):
                    continue
                number, crosses = number + 1, False
            record.append(line)
            inside = open_after(line, inside)
            if not inside:
                close(not crosses)
                record = []
        if len(out) >= 4096:
            yield batch()
    if record:
        close(False)
    yield batch()


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """Rows of files without a header: path, line_no, cells.

    A row is a logical record: quoted line breaks belong to their cell, where they become
    ``\\n``; quotes inside a plain cell are plain. ``line_no`` counts a file's records from
    0; blank lines between records are none. Files are read by splits, twice: once to
    learn how each split leaves its quotes if it begins inside or outside of them, from
    which follows how the next one begins, and once for the records. Only pieces of
    records that cross a border of splits are shuffled.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), "value")
    ends = lines.mapInArrow(_split_ends, "path string, block long, plain_end boolean, plain_n long, quoted_end boolean, quoted_n long")
    order = Window.partitionBy("path").orderBy("block")
    # A split fixes how it ends, keeps how it began, or turns it round; the last fixed end and the turns since tell.
    turns = F.sum((F.col("plain_end") & ~F.col("quoted_end")).cast("int")).over(order)
    fixed = F.when(F.col("plain_end") == F.col("quoted_end"), F.struct("plain_end", "turns"))
    known = ends.withColumn("turns", turns).withColumn("fixed", F.last(fixed, ignorenulls=True).over(order))
    after = (F.coalesce(F.col("fixed.plain_end").cast("int"), F.lit(0)) + F.col("turns") - F.coalesce("fixed.turns", F.lit(0))) % 2 == 1
    begun = known.withColumn("after", after).withColumn("inside", F.coalesce(F.lag("after").over(order), F.lit(False)))
    own = F.when(F.col("inside"), F.col("quoted_n")).otherwise(F.col("plain_n"))
    starts = saved(begun.withColumn("before", F.sum(own).over(order) - own).select("path", "block", "inside", "before"))
    if starts.count() <= MOST_SPLITS:
        placed = lines.join(F.broadcast(starts), ["path", "block"])
    else:
        placed = lines.withColumn("at", F.monotonically_increasing_id()).join(starts.hint("merge"), ["path", "block"]).sortWithinPartitions("path", "block", "at")
    pieces = placed.select("path", "block", "inside", "before", "value").mapInArrow(_pieces, PIECE)
    whole = pieces.filter("whole").select("path", "line_no", "text")
    crossing = pieces.filter("NOT whole").groupBy("path", "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return whole.unionByName(crossing).select("path", "line_no", cells_of(F.col("text")).alias("cells"))


def cells_of(record: Column) -> Column:
    """Cells of a logical record; what follows a closing quote belongs to the cell."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(r',("(?:[^"]++|"")*+"?[^,]*+|[^,]*+)'), F.lit(1))
    quoted_part = lambda c: F.replace(F.regexp_extract(c, r'^"((?:[^"]++|"")*+)', 1), F.lit('""'), F.lit('"'))
    rest = lambda c: F.regexp_extract(c, r'^"(?:[^"]++|"")*+"?([\s\S]*)$', 1)
    return F.transform(cells, lambda c: F.when(c.startswith('"'), F.concat(quoted_part(c), rest(c))).otherwise(c))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True, schema="csv string, source_file string, sheet string, profession string, category string, rows int, cols int")


def summary_sheets(entries: DataFrame) -> DataFrame:
    """Of each category the summary sheet, else the one with most rows."""
    order = F.struct(F.col("sheet") != "汇总", -F.col("rows"), "csv")
    return entries.groupBy("category").agg(F.min_by(F.struct(*entries.columns), order).alias("e")).select("e.*")


#: Sheets that are no projects: by their whole name, and by a word in it.
NO_PROJECTS, NO_PROJECT_WORDS = ("汇总", "Sheet1"), ("计价", "参数", "明细", "投标", "技术")


def project_names(entries: DataFrame) -> DataFrame:
    """The sheets that name a project."""
    sheet = F.col("sheet")
    return entries.filter(~sheet.isin(*NO_PROJECTS) & ~sheet.rlike("|".join(NO_PROJECT_WORDS))).select(F.trim(sheet).alias("name")).filter("name <> ''").distinct()


def project_counts(entries: DataFrame) -> DataFrame:
    """Project sheets by category: category, n_projects; here any sheet whose name begins with Sheet is none."""
    sheet = F.col("sheet")
    named = (sheet != "汇总") & ~sheet.startswith("Sheet") & ~sheet.rlike("|".join(NO_PROJECT_WORDS))
    return entries.groupBy("category").agg(F.count_if(named).alias("n_projects"))


def fanned_out(sheets: DataFrame, path: str, kinds: DataFrame) -> DataFrame:
    """Sheets (path, sheet, line_no, cells) written as one folder of Parquet a sheet, and the manifest of what was written.

    ``kinds``: sheet's source path, profession and category. The manifest has one row a
    sheet: csv (its folder), source_file, sheet, profession, category, rows, cols.
    """
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    rows = sheets.withColumn("folder", F.concat_ws("__", name, F.col("sheet")))
    rows.select("folder", "line_no", "cells").write.mode("overwrite").partitionBy("folder").parquet(path)
    sizes = rows.groupBy("path", "sheet", "folder").agg(F.count("*").cast("int").alias("rows"), F.max(F.size("cells")).alias("cols"))
    source = F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file")
    return sizes.join(kinds.select("path", "profession", "category"), "path", "left").select(F.col("folder").alias("csv"), source, "sheet", "profession", "category", "rows", "cols")


# Of each category's files, rows to skip and where the fields are (from 0; negative: from the end).
LAYOUTS: dict[str, dict] = {
    "桥架": {"skip": 1, "name": 1, "spec": 2, "quantity": 7, "unit": 8, "price": 9, "brand": 13, "material": 3, "remark": 15},
    "阀门": {"skip": 3, "name": 2, "spec": 3, "unit": 11, "quantity": 12, "total": 17, "brand": 18, "material": 6, "excl": 13, "remark": 19},
    "风口风阀": {"skip": 1, "name": 1, "spec": 3, "quantity": 5, "unit": 6, "price": 7, "brand": 9, "remark": 10},
    "母线槽": {"skip": 1, "name": 1, "spec": 3, "brand": 8, "unit": 10, "quantity": 11, "price": 14, "excl": 12, "remark": 16},
    "不锈钢管": {"skip": 1, "name": 1, "spec": 2, "unit": 7, "quantity": 8, "price": 11, "brand": 13, "excl": 9, "remark": 14},
    "水箱": {"skip": 1, "name": 1, "spec": 2, "unit": 3, "quantity": 4, "total": 9, "brand": 11, "excl": 5, "material": 12, "remark": 13},
    "潜水泵": {"skip": 1, "name": 1, "spec": 2, "quantity": 7, "price": 9, "brand": 11, "remark": 12},
    "风机盘管": {"skip": 1, "name": 1, "spec": 2, "quantity": 5, "unit": 6, "price": 11, "brand": 13, "remark": 14},
    "空调泵": {"skip": 2, "name": 0, "spec": 1, "quantity": -6, "price": -4, "brand": -2, "remark": -1, "numbered": False},
}


def category_rows(lines: DataFrame, category: str) -> DataFrame:
    """Data rows of a category's sheets: path, line_no, name, spec, brand, unit, quantity, price, category, material_type, price_excl, remark.

    A data row has a whole number in its first cell; where rows are not numbered, a name
    that is no heading. Where a layout has a total, the price is total by quantity. A
    numeric brand is none; a cell that is missing is null.
    """
    at = LAYOUTS[category]
    place = lambda f: F.lit(at[f] + 1 if at[f] >= 0 else at[f])
    cell = lambda f: F.trim(F.try_element_at("cells", place(f))) if f in at else F.lit(None).cast("string")
    data = F.trim(F.col("cells")[0]).rlike("^[0-9]+$") if at.get("numbered", True) else (cell("name") != "") & ~cell("name").contains("名称")
    quantity = import_number(cell("quantity"))
    price: Column = import_number(cell("price")) if "price" in at else F.try_divide(import_number(cell("total")), quantity)
    brand = F.when((cell("brand") != "") & cell("brand").try_cast("double").isNull(), cell("brand"))
    rows = lines.filter(F.col("line_no") >= at["skip"]).filter(data)
    return rows.select("path", "line_no", cell("name").alias("name"), cell("spec").alias("spec"), brand.alias("brand"), cell("unit").alias("unit"), quantity.alias("quantity"), price.alias("price"), F.lit(category).alias("category"), cell("material").alias("material_type"), import_number(cell("excl")).alias("price_excl"), cell("remark").alias("remark"))


def box_totals(lines: DataFrame) -> DataFrame:
    """Distribution boxes: a total row takes the last box header (12-3 in its first cell) above it, named by the header's next two cells, and its first positive number from the fourth cell on."""
    upward = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.trim(F.concat_ws(" ", F.try_element_at("cells", F.lit(2)), F.try_element_at("cells", F.lit(3))))
    rows = lines.withColumn("box", F.last(F.when(F.trim(F.col("cells")[0]).rlike("^[0-9]+-[0-9]+"), name), ignorenulls=True).over(upward))
    prices = F.filter(F.transform(F.slice("cells", 4, 1000), import_number), lambda x: x > 0)
    total = F.exists(F.slice("cells", 1, 3), lambda c: c.contains("单台合计") | c.contains("总计"))
    return rows.filter(total).withColumn("price", F.try_element_at(prices, F.lit(1))).filter("box IS NOT NULL AND price IS NOT NULL").select("path", "line_no", "box", "price")


def raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents by content: path, file_hash, file_size, content."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("file_hash"), F.col("length").alias("file_size"), "content")


class SharedStrings:
    """A workbook's table of texts, in a scratch file of the task with the texts' places in memory: eight bytes a text."""

    def __init__(self, book: zipfile.ZipFile):
        self.file, self.at = tempfile.TemporaryFile(), array("Q", [0])
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as f:
                for si in _elements(f, "si"):
                    # Readings of a text for East Asian scripts (rPh) are no part of it.
                    text = "".join(t.text or "" for t in [*si.findall(f"{MAIN}t"), *si.findall(f"{MAIN}r/{MAIN}t")])
                    self.at.append(self.at[-1] + self.file.write(text.encode("utf-8", "surrogatepass")))

    def __getitem__(self, k: int) -> str:
        self.file.seek(self.at[k])
        return self.file.read(self.at[k + 1] - self.at[k]).decode("utf-8", "surrogatepass")


def _elements(f, name: str) -> Iterator[ElementTree.Element]:
    """Elements of a name as they end; what was read is let go."""
    parsed = ElementTree.iterparse(f, ("start", "end"))
    _, root = next(parsed)
    for event, e in parsed:
        if event == "end" and e.tag == f"{MAIN}{name}":
            yield e
            e.clear()
            root.clear()
            for inner in root.iter(f"{MAIN}sheetData"):
                inner.clear()


def sheet_members(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets, in order, and where they are in it."""
    places = {r.get("Id"): r.get("Target", "").removeprefix("/xl/") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), f"xl/{places[s.get(REL)]}") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet") if s.get(REL) in places]


def sheet_rows(book: zipfile.ZipFile, member: str, strings: SharedStrings) -> Iterator[tuple[int, list[str | None]]]:
    """Row number and cells of a sheet, row by row."""
    with book.open(member) as f:
        for k, row in enumerate(_elements(f, "row")):
            cells: list[str | None] = []
            for c in row.iter(f"{MAIN}c"):
                column = 0
                for x in c.get("r", ""):
                    column = column * 26 + ord(x) - 64 if x.isalpha() else column
                cells += [None] * (column - 1 - len(cells))
                value = c.find(f"{MAIN}v")
                if c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{MAIN}t")))
                else:
                    cells.append(None if value is None else strings[int(value.text)] if c.get("t") == "s" else value.text)
            yield int(row.get("r", k + 1)) - 1, cells


def sheets_of(content: bytes) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet name, row number and cells of an .xlsx file."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = SharedStrings(z)
        for name, member in sheet_members(z):
            for row in sheet_rows(z, member, strings):
                yield (name, *row)


#: Rows that leave a task at once.
ROWS = 2_000


def workbook_rows(documents: DataFrame) -> DataFrame:
    """All sheets of .xlsx files (path, content): path, sheet, line_no, cells; one file a task at a time, for stores that only Spark reads."""

    def each(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = sheets_of(content)
                while part := list(islice(rows, ROWS)):
                    yield pd.DataFrame([(path, *r) for r in part], columns=["path", "sheet", "line_no", "cells"])

    return documents.select("path", "content").mapInPandas(each, SHEET)


class _Sheet(InputPartition):
    def __init__(self, path: str, sheet: str, member: str):
        self.path, self.sheet, self.member = path, sheet, member


def _opened(path: str):
    """A file of any store that Arrow knows (local, hdfs, s3, gs ...), read from by parts."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store.open_input_file(place)


def _listed(pattern: str) -> list[str]:
    """Files of a path, of a folder, or with a pattern in the last part of a path."""
    from fnmatch import fnmatch

    from pyarrow import fs

    scheme = pattern.split("://")[0] + "://" if "://" in pattern else ""
    folder, _, last = pattern.rpartition("/")
    store, place = fs.FileSystem.from_uri(folder) if scheme else (fs.LocalFileSystem(), folder or ".")
    whole = f"{place}/{last}"
    if not set(last) & set("*?["):
        info = store.get_file_info(whole)
        if info.type == fs.FileType.File:
            return [pattern]
        place, last, folder = whole, "*.xlsx", pattern
    found = store.get_file_info(fs.FileSelector(place))
    return sorted(f"{folder}/{i.base_name}" if folder else i.base_name for i in found if i.type == fs.FileType.File and fnmatch(i.base_name, last))


class _Reader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self) -> list[InputPartition]:
        """One a sheet; of each workbook only its list of sheets is read here."""
        found = []
        for path in self.files:
            with _opened(path) as f, zipfile.ZipFile(f) as z:
                found += [_Sheet(path, *s) for s in sheet_members(z)]
        return found

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with _opened(partition.path) as f, zipfile.ZipFile(f) as z:
            for row in sheet_rows(z, partition.member, SharedStrings(z)):
                yield (partition.path, partition.sheet, *row)


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)``: a partition a sheet, which streams through; ``workbook_rows`` is for stores that only Spark reads."""

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return SHEET

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_listed(self.options["path"]))


def category_order(category: Column) -> Column:
    """Place in the declared order; others last."""
    place = F.array_position(F.array(*map(F.lit, CATEGORIES)), category)
    return F.when(place > 0, place).otherwise(len(CATEGORIES) + 1)



def sheet_with_header(spark: SparkSession, path: str) -> DataFrame:
    """One sheet whose first record names its columns: all strings, and ``line_no`` from 0 below the header.

    Cells that are missing are null; a column without a name is called by its number.
    """
    rows = saved(raw_lines(spark, path))
    head = rows.filter("line_no = 0").first()
    names = [c.strip() or str(k) for k, c in enumerate(head.cells)] if head else []
    cells = [F.get("cells", k).alias(name) for k, name in enumerate(names)]
    return rows.filter("line_no > 0").select((F.col("line_no") - 1).alias("line_no"), *cells)
