"""Changes of a table as one feed: inserts, updates and deletes by their rules, with what was rejected and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalog import numbered

#: Why a change is rejected.
BLANK, DUPLICATE, MISSING, REFERENCED = "blank", "duplicate", "missing", "referenced"


@dataclass
class Applied:
    """The table after the feed, what was rejected (the feed's rows and ``reason``), and each accepted or rejected operation's count (op, outcome, n)."""

    table: DataFrame
    rejects: DataFrame
    counts: DataFrame


def _named(value: Column) -> Column:
    return F.trim(value)


def applied(table: DataFrame, feed: DataFrame, unique: str = "name", references: tuple[tuple[DataFrame, str], ...] = ()) -> Applied:
    """``table`` (id, ``unique``, ...) after ``feed`` (seq, op, id and the table's columns), taken in the order of ``seq``.

    An insert needs a name that is not blank, that no row of the table has and no earlier
    insert; it gets the next free id by the order of names. An update puts its values
    that are not null into a row that is there; a name of another row is a duplicate, of
    the table as it was. A delete needs a row that is there and that no row of
    ``references`` (table, column) names. What comes after a row's delete finds it
    missing. Names are compared trimmed; the names that the feed's deletes set free are
    free from the next feed on.
    """
    columns = [c for c in table.columns if c not in ("id", unique)]
    known = table.select("id", F.col(unique).alias("_name"))
    names = known.groupBy(F.col("_name").alias("_taken")).agg(F.min("id").alias("_owner"), F.count("*").alias("_owners"))
    rows = feed.withColumn("_new", _named(F.col(unique))).join(names, F.col("_new") == F.col("_taken"), "left").drop("_taken")
    inserts = rows.filter("op = 'insert'")
    earliest = inserts.filter("_new <> '' AND _owner IS NULL").groupBy("_new").agg(F.min("seq").alias("_first"))
    judged_inserts = inserts.join(earliest, "_new", "left").withColumn(
        "reason", F.when(F.coalesce(F.col("_new"), F.lit("")) == "", BLANK).when(F.col("_owner").isNotNull() | (F.col("seq") > F.col("_first")), DUPLICATE)
    )

    others = rows.filter("op IN ('update', 'delete')").join(known.select("id", F.lit(True).alias("_there")), "id", "left")
    used = None
    for referring, column in references:
        ids = referring.select(F.col(column).alias("id")).filter("id IS NOT NULL").distinct()
        used = ids if used is None else used.unionByName(ids).distinct()
    others = others.join(used.withColumn("_used", F.lit(True)), "id", "left") if used is not None else others.withColumn("_used", F.lit(None).cast("boolean"))
    gone = others.filter("op = 'delete' AND _there AND _used IS NULL").groupBy("id").agg(F.min("seq").alias("_gone"))
    owned = (F.col("_owners") == 1) & (F.col("_owner") == F.col("id"))
    judged = others.join(gone, "id", "left").withColumn(
        "reason",
        F.when(F.col("_there").isNull() | (F.col("seq") > F.col("_gone")), MISSING)
        .when((F.col("op") == "delete") & F.col("_used"), REFERENCED)
        .when((F.col("op") == "update") & F.col("_owner").isNotNull() & ~owned, DUPLICATE),
    )

    last = lambda c, value: F.max_by(value, F.when(value.isNotNull(), F.col("seq"))).alias(f"_{c}")
    values = [last(c, F.col(c)) for c in columns] + [last(unique, F.when(F.col("_new") != "", F.col("_new")))]
    folded = judged.filter("op = 'update' AND reason IS NULL").groupBy("id").agg(*values)
    kept = table.join(gone.select("id"), "id", "left_anti").join(folded, "id", "left")
    kept = kept.select(*[F.coalesce(f"_{c}", c).alias(c) if c != "id" else F.col(c) for c in table.columns])
    accepted = judged_inserts.filter("reason IS NULL").select(F.col("_new").alias(unique), *columns)
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    places = numbered(accepted.select(unique), unique).crossJoin(F.broadcast(top)).select(unique, (F.col("_top") + F.col("_k")).alias("id"))
    made = accepted.join(places, unique).select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    every = judged_inserts.select(*feed.columns, "reason").unionByName(judged.select(*feed.columns, "reason"))
    counts = every.groupBy("op", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
    return Applied(kept.unionByName(made), every.filter("reason IS NOT NULL"), counts)


def winners(batches: DataFrame, keys: list[str], confirmed: DataFrame | None = None) -> DataFrame:
    """Of each key one row of all staged batches (batch_id, seq, ...): that of the smallest batch, in it of the smallest seq.

    It does not matter which batch was staged first. Keys that ``confirmed`` has already
    are left out: what was confirmed before stays.
    """
    first = batches.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batches.columns if c not in keys]), F.struct("batch_id", "seq")).alias("_r")).select(*keys, "_r.*")
    return first if confirmed is None else first.join(confirmed.select(*keys), keys, "left_anti")
