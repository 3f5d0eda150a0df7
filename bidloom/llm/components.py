"""Connected components of links between numbers, by alternating stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the least
node known around it. Rounds end when nothing changes; their number grows with the
logarithm of the longest chain. A round's links are written to the shared folder, so
a lost executor costs one round at most. Minima are combined before the shuffle; in the
joins, a node with more than a ten-thousandth of all links gets its minimum by a
broadcast of those few nodes, so no task holds all its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, joined_per_key


def _lowered(links: DataFrame) -> DataFrame:
    """Of each node, its larger neighbours hung on the least node known around it: child, parent."""
    both = links.select(F.col("child").alias("n"), F.col("parent").alias("v")).unionByName(
        links.select(F.col("parent").alias("n"), F.col("child").alias("v"))
    )
    least = Saved(both.groupBy("n").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("n")).alias("size")).select("n", F.least("n", "m").alias("m"), "size"))
    large = Saved(joined_per_key(both.filter("v > n"), least.df, ["n"], "size").select(F.col("v").alias("child"), F.col("m").alias("parent")).distinct())
    least.delete()
    return large


def _round(links: DataFrame) -> Saved:
    large = _lowered(links)
    least = Saved(large.df.groupBy("child").agg(F.min("parent").alias("m"), F.count("*").alias("size")))
    small = joined_per_key(large.df, least.df, ["child"], "size").filter("parent <> m").select(F.col("parent").alias("child"), F.col("m").alias("parent"))
    out = Saved(small.unionByName(least.df.select("child", F.col("m").alias("parent"))).distinct())
    large.delete()
    least.delete()
    return out


def components(links: DataFrame) -> DataFrame:
    """For links (a, b): one row per linked node but the roots: node, root (the least node of its component).

    Null ends and links of a node with itself are ignored; repeated links count once;
    no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    now = Saved(links.filter(a != b).select(F.greatest(a, b).alias("child"), F.least(a, b).alias("parent")).distinct())
    state = None
    while True:
        state, before = now.df.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first(), state
        if state == before or state[0] == 0:
            return now.df.select(F.col("child").alias("node"), F.col("parent").alias("root"))
        last, now = now, _round(now.df)
        last.delete()
