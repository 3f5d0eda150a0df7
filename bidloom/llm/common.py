"""What several operators share: saved tables, Arrow batches and documents."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder in the one all executors share, which the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine may do without a name; it gets a temporary folder. A
    cluster that names none is an error: a machine's own folder is no shared one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        named = sc.getCheckpointDir()
    return f"{named}/bidloom-{sc.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Remove all tables this application has saved; call it when the operators' results have been read or written."""
    _delete(spark, shared_folder(spark))


class Saved:
    """A table in the shared folder: it cuts lineage, and lost executors cost no recomputation.

    Operators delete those they have done with. A table that a returned DataFrame still
    reads stays until ``clean``.
    """

    def __init__(self, df: DataFrame, options: dict | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/{uuid.uuid4().hex}"
        df.write.options(**options or {}).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def delete(self) -> None:
        _delete(self.spark, self.path)


#: Keys of a join that are broadcast, at most.
HOT_KEYS = 10_000


def joined_per_key(rows: DataFrame, per_key: DataFrame, on: list[str], size: str) -> DataFrame:
    """``rows`` joined with ``per_key``, one row a key (nulls never meet), whose column ``size`` counts the key's rows.

    A key with more than a ten-thousandth of all rows would meet in one task. There are
    at most ``HOT_KEYS`` of them, so they may be broadcast; the rest is shuffled. Both
    inputs are read twice, so save what is dear.
    """
    total = per_key.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.col(size) > total // HOT_KEYS
    few, many = F.broadcast(per_key.filter(hot)), per_key.filter(~hot)
    return rows.join(few, on).unionByName(rows.join(F.broadcast(per_key.filter(hot).select(*on)), on, "left_anti").join(many, on))


def quoted(name: str) -> str:
    """A column's name as a reference, dots included."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(columns: list[list], rows: int = 256) -> Iterator[list[list]]:
    """Runs of at most ``rows`` rows of equally long columns."""
    for at in range(0, len(columns[0]) if columns else 0, rows):
        yield [c[at : at + rows] for c in columns]


def map_arrow(df: DataFrame, each: Callable[..., Iterable[dict]], schema: str) -> DataFrame:
    """Apply ``each`` to small runs of rows of ``df``.

    ``each`` gets one Python list per column and yields dicts of lists: the output
    columns by name. Runs are short, so that memory follows the longest texts of a
    run and not the Arrow batch.
    """
    kinds = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for out in each(*[c.to_pylist() for c in part.columns]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(batches, kinds)
