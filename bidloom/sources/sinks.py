"""Exports: Parquet, CSV, JSON log lines and a small .xlsx writer."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an exported quote sheet.
EXPORT_ROWS = 10_000


def overwritten(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _file_system(spark, path)
    return fs.exists(place)


def swapped(df: DataFrame, path: str) -> None:
    """``df`` in the place of the folder ``path``, which it may read: written beside it, then put there by two renames.

    A run that dies in between leaves the new or the old folder beside; the next call, or ``settled``, puts it back.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    fs, place = _file_system(spark, path)
    (_, new), (_, old) = _file_system(spark, f"{path}.new"), _file_system(spark, f"{path}.old")
    fs.delete(old, True)
    if fs.exists(place):
        fs.rename(place, old)
    if not fs.rename(new, place):
        raise OSError(f"{path}.new can't be renamed")
    fs.delete(old, True)


def settled(spark: SparkSession, path: str) -> None:
    """After a run that died: a whole new folder takes its place, else the old one comes back."""
    fs, place = _file_system(spark, path)
    (_, new), (_, old), (_, done) = (_file_system(spark, f"{path}{end}") for end in (".new", ".old", ".new/_SUCCESS"))
    if not fs.exists(place):
        fs.rename(new if fs.exists(done) else old, place)
    for left in (new, old):
        fs.delete(left, True)


def staged(df: DataFrame, path: str, batch_id: str) -> None:
    """A batch's rows beside those of other batches; a batch that comes again takes its own place."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def log_lines(df: DataFrame) -> DataFrame:
    """Rows as JSON, one column ``value``, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def flattened(df: DataFrame) -> DataFrame:
    """Arrays as comma-joined text, so that a sheet can hold them."""
    return df.select(*[F.array_join(c, ", ").alias(c) if kind.startswith("array<string") else F.col(c) for c, kind in df.dtypes])


def xlsx(sheets: dict[str, DataFrame], path: str, most: int = EXPORT_ROWS) -> None:
    """A workbook of at most ``most`` rows a sheet: a report for people, so it may pass through the driver."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = list(sheets)
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k + 1}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(len(names)))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{k + 1}" r:id="r{k + 1}"/>' for k, n in enumerate(names)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(names))) + "</Relationships>")
        for k, df in enumerate(sheets.values()):
            flat = flattened(df)
            rows = [flat.columns, *flat.limit(most).collect()]
            body = "".join("<row>" + "".join(_cell(v) for v in r) + "</row>" for r in rows)
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def _cell(v) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, int | float) and not isinstance(v, bool):
        return f"<c><v>{v}</v></c>"
    return f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
