"""Exact deduplication with DataFrame operations only.

Texts are grouped by a 128-bit content hash (MD5); the text itself is the second
grouping key, so the aggregate compares the bytes inside each hash group and a
collision yields two groups. Copies collapse in the map-side aggregate: a group
that holds a third of all rows sends one row a task.

Rules, by case:

* null text counts as empty; all empty texts are one group;
* of equal texts, the row with the largest id stays (``keep="smallest"``: the smallest);
* a null id never wins over another id; a group of null ids only keeps null;
* repeated rows (same id, same text) are counted each; ``groups`` marks all of them
  as kept, ``deduplicated`` returns one;
* extra columns are ignored by ``groups`` and returned by ``deduplicated``;
* columns of any type and name (maps, names with dots) come back as they were;
* an empty table gives an empty result.

The rows of a group that holds more than a ten-thousandth of all rows get its result by
a broadcast of those few groups, the others by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, joined_per_key, quoted, text_or_empty


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(quoted(text_col))
    best = F.max if keep == "largest" else F.min
    keyed = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.unhex(F.md5(text)).alias("h"), text.alias("t"))
    sha = lambda t: F.unhex(F.sha2(t, 256))
    found = Saved(
        keyed.groupBy("h", "t")
        .agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", sha(F.col("t")).alias("sha"), "keep_id", "group_size")
    ).df
    # The rows travel without their text; SHA-256 tells the texts of a colliding MD5 group apart.
    rows = keyed.select("doc_id", "h", sha(F.col("t")).alias("sha"))
    return joined_per_key(rows, found, ["h", "sha"], "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, and its columns as they were."""
    best = F.max_by if keep == "largest" else F.min_by
    text = text_or_empty(quoted(text_col))
    # Null ids never win. Of rows with the best id, the one whose other columns are the last (first) as JSON stays.
    i = F.col(quoted(id_col))
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    tie = F.to_json(F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(others)])) if others else F.lit("")
    order = F.struct((i.isNotNull() if keep == "largest" else i.isNull()).alias("o"), i.alias("i"), tie.alias("tie"), F.col(quoted(text_col)).isNotNull().alias("n"))
    row = F.struct(i.alias("i"), F.col(quoted(text_col)).isNull().alias("null"), *[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(others)])
    kept = docs.select(F.unhex(F.md5(text)).alias("h"), text.alias("t"), order.alias("order"), row.alias("row")).groupBy("h", "t").agg(best("row", "order").alias("row"))
    back = {id_col: F.col("row.i"), text_col: F.when(~F.col("row.null"), F.col("t"))} | {c: F.col(f"row.c{k}") for k, c in enumerate(others)}
    return kept.select(*[back[c].alias(c) for c in docs.columns])


ORACLE = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
             sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW w AS (PARTITION BY coalesce(text, '')))
"""
