"""Lists with optional filters and pages, lookups, codes and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bidloom.functions.constants import CATEGORY_ABBREVIATIONS, EXTENDED_ATTRIBUTES, NAMING, PROFESSION_ABBREVIATIONS
from bidloom.sources.shared import saved


def contains(column: str, keyword: str) -> Column:
    """The keyword anywhere, capitals or not; its % and _ are wildcards."""
    return F.col(column).ilike(f"%{keyword}%")


def filtered(rows: DataFrame, equal: dict | None = None, keyword: str | None = None, keyword_columns: tuple[str, ...] = (), at_least: dict | None = None, at_most: dict | None = None) -> DataFrame:
    """Optional filters: an empty value (None, 0, '') filters nothing."""
    for name, value in (equal or {}).items():
        rows = rows.filter(F.col(name) == value) if value else rows
    for name, value in (at_least or {}).items():
        rows = rows.filter(F.col(name) >= value) if value else rows
    for name, value in (at_most or {}).items():
        rows = rows.filter(F.col(name) <= value) if value else rows
    if keyword:
        hit = F.lit(False)
        for c in keyword_columns:
            hit = hit | F.coalesce(contains(c, keyword), F.lit(False))
        rows = rows.filter(hit)
    return rows


def page(rows: DataFrame, order: list, number: int = 1, size: int = 20) -> DataFrame:
    """One page; numbers from 1, sizes from 1 to 100."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError("page >= 1 and 1 <= size <= 100")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def named_quotes(quotes: DataFrame, materials: DataFrame, suppliers: DataFrame, projects: DataFrame) -> DataFrame:
    """Quotes with the names of what they refer to; missing ones are null."""
    m = materials.select(F.col("id").alias("material_id"), F.col("standard_name").alias("material"), "category", "profession")
    s = suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier"))
    p = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    return quotes.join(m, "material_id", "left").join(s, "supplier_id", "left").join(p, "project_id", "left")


def visible_materials(materials: DataFrame) -> DataFrame:
    """Not disabled; without a status is visible."""
    return materials.filter("status IS NULL OR status <> 'disabled'")


def suppliers_in(suppliers: DataFrame, category: str) -> DataFrame:
    return suppliers.filter(F.array_contains("categories", category))


def tiers_for(tiers: DataFrame, category: str) -> DataFrame:
    return tiers.filter((F.col("category") == category) | F.col("category").isNull())


def unknown_brands(quotes: DataFrame, tiers: DataFrame) -> DataFrame:
    """Brands that are quoted and have no tier."""
    return quotes.filter("brand <> ''").select("brand").distinct().join(tiers.select(F.col("brand_name").alias("brand")), "brand", "left_anti")


def code_prefix(profession: Column, category: Column) -> Column:
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.concat_ws("-", F.coalesce(F.element_at(table(PROFESSION_ABBREVIATIONS), profession), F.lit("OT")), F.coalesce(F.element_at(table(CATEGORY_ABBREVIATIONS), category), F.lit("GEN")))


def code_text(number: Column) -> Column:
    """A number of a code: five digits at least."""
    text = number.cast("string")
    return F.when(F.length(text) >= 5, text).otherwise(F.lpad(text, 5, "0"))


def coded(new: DataFrame, existing: DataFrame, prefix: str = "prefix", code: str = "material_code", order: list[str] | None = None) -> DataFrame:
    """``new`` with the next codes of their prefix: PP-CCC-00001 on, after the largest number in use.

    All rows are numbered in range partitions by prefix and ``order``; a row's number in
    its prefix follows from the prefix's first one, so a prefix may have any share of the rows.
    """
    used = existing.select(F.regexp_extract(code, r"^(.*)-[0-9]+$", 1).alias(prefix), F.regexp_extract(code, r"([0-9]+)$", 1).try_cast("long").alias("_n")).groupBy(prefix).agg(F.max("_n").alias("_n"))
    rows = placed(new, [prefix, *(order or [c for c in new.columns if c != prefix])])
    first = rows.groupBy(prefix).agg(F.min("_k").alias("_first")).join(used, prefix, "left")
    number = F.col("_k") - F.col("_first") + 1 + F.coalesce("_n", F.lit(0))
    return rows.join(first, prefix).withColumn(code, F.concat_ws("-", prefix, code_text(number))).drop("_n", "_k", "_first")


#: Rows that are numbered in one window.
NAMES = 100_000


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``_k``, their place by ``order`` from 1: in range partitions, which are numbered in turn. Rows that tie in ``order`` have any of their places."""
    parts = max(1, -(-rows.count() // NAMES))
    ranged = saved(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    sizes = sizes.select("_p", (F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(sizes, "_p").withColumn("_k", (place + F.col("_before")).cast("long")).drop("_p", "_before")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """Distinct ``names`` with ``_k``, their place in order from 1."""
    return placed(names.select(name), [name])


def get_or_create(names: DataFrame, existing: DataFrame, name: str = "name") -> DataFrame:
    """id and name of every trimmed, non-blank name: the existing ids, and new ones after the largest."""
    wanted = names.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct()
    known = existing.groupBy(name).agg(F.min("id").alias("id"))
    fresh = saved(wanted.join(known, name, "left_anti"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    made = numbered(fresh, name).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_k")).alias("id"), name)
    return known.join(wanted, name, "left_semi").select("id", name).unionByName(made)


def folded_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?U)\s", ""))


def _pieces_of(c: Column) -> Column:
    """The different pairs of neighbouring characters of a name, and its characters."""
    n = F.length(c)
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(pairs, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(1)))))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Pairs of names of which ``outer`` (o) holds ``inner`` (i): an inner name is looked for at its rarest piece among the outer ones, alone.

    An outer name that holds the inner one holds all its pieces, so none is lost; a pair
    that is common among the outer names draws nothing unless it is a name's rarest.
    """
    pieces = outer.select("o", F.explode(_pieces_of(F.col("o"))).alias("k"))
    frequent = pieces.groupBy("k").agg(F.count("*").alias("df"))
    length = F.length("i")
    own = inner.select("i", F.explode(F.filter(_pieces_of(F.col("i")), lambda k: (F.length(k) == 2) | (length == 1))).alias("k"))
    rarest = own.join(frequent, "k").groupBy("i").agg(F.min_by("k", F.struct("df", "k")).alias("k"))
    # A name with a piece that no outer name has is in none of them.
    lost = own.join(frequent, "k", "left_anti").select("i")
    return rarest.join(lost, "i", "left_anti").join(pieces, "k").filter(F.contains("o", F.col("i"))).select("i", "o")


def matched_suppliers(detected: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Detected names (name) with the first supplier (by id) whose name is the same but for blanks and capitals, contains the name, or is contained in it: name, supplier_id.

    Equal names join by their folded form; names that hold another meet at the other's
    rarest pair of characters, names of one character at that.
    """
    names = detected.select("name").filter("name <> ''").distinct()
    pool = suppliers.filter("name <> ''").groupBy(F.col("name").alias("of")).agg(F.min("id").alias("supplier_id"))
    equal = names.withColumn("k", folded_name(F.col("name"))).join(pool.withColumn("k", folded_name(F.col("of"))), "k").select("name", "of")
    inside = _contained(pool.select(F.col("of").alias("i")), names.select(F.col("name").alias("o"))).select(F.col("o").alias("name"), F.col("i").alias("of"))
    around = _contained(names.select(F.col("name").alias("i")), pool.select(F.col("of").alias("o"))).select(F.col("i").alias("name"), F.col("o").alias("of"))
    found = equal.unionByName(inside).unionByName(around)
    return found.join(pool, "of").groupBy("name").agg(F.min("supplier_id").alias("supplier_id"))


def updated(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the non-null columns of ``changes`` (one row a key); columns that follow from others are not computed anew."""
    new = [c for c in changes.columns if c != key]
    named = changes.select(key, *[F.col(c).alias(f"_{c}") for c in new])
    return table.join(named, key, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def without(table: DataFrame, column: str, value) -> DataFrame:
    """Rows but those with a value: a batch or a row deleted."""
    return table.filter(~F.col(column).eqNullSafe(F.lit(value)))


def without_group(groups: DataFrame, items: DataFrame, group_id: int) -> tuple[DataFrame, DataFrame]:
    """Groups and their items after a group and all its items were deleted."""
    return without(groups, "id", group_id), without(items, "group_id", group_id)


def applied_alignment(groups: DataFrame, items: DataFrame, fixes: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suggested groups that were not rejected, their items, and the quotes with the unit prices that were fixed.

    ``fixes``: quote_id, field, new_value; only those of unit_price with a value count,
    of a quote's the last by value.
    """
    live = groups.filter("status <> 'rejected'")
    inside = items.join(live.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    good = fixes.filter("field = 'unit_price' AND new_value IS NOT NULL").groupBy(F.col("quote_id").alias("id")).agg(F.max("new_value").alias("unit_price"))
    return live, inside, updated(quotes, good)


def alignment_rows(valid: DataFrame, suppliers: DataFrame, supplier_ids: list[int], project_id: int | None = None, category: str | None = None, most: int = 60) -> DataFrame:
    """The first rows by material and supplier name that a model is asked to align."""
    rows = valid.filter(F.col("supplier_id").isin(supplier_ids)).join(suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id")
    for column, value in (("project_id", project_id), ("category", category)):
        rows = rows.filter(F.col(column) == value) if value else rows
    named = rows.select(F.col("id").alias("quote_id"), "supplier_id", "supplier_name", F.col("standard_name").alias("material_name"), "spec", "quantity", "unit_price", "total_price")
    return named.orderBy("material_name", "supplier_name", "quote_id").limit(most)


def constants(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The extended attributes and the naming parts of categories as tables."""
    attributes = [(c, k + 1, *row) for c, rows in EXTENDED_ATTRIBUTES.items() for k, row in enumerate(rows)]
    naming = [(c, part, k + 1, v) for c, parts in NAMING.items() for part, values in parts.items() for k, v in enumerate(values)]
    return spark.createDataFrame(attributes, "category string, position int, key string, label string, source string, role string"), spark.createDataFrame(naming, "category string, part string, position int, value string")


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``table`` with ``rows`` in the place of those with equal keys (null equals null), new ones added; of rows with equal keys the last by ``order``, else by all their values."""
    by = F.struct(*([order] if order else sorted(c for c in rows.columns if c not in keys)))
    rest = [c for c in rows.columns if c not in keys]
    new = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_r")).select(*keys, "_r.*") if rest else rows.distinct()
    same = None
    for k in keys:
        same = table[k].eqNullSafe(new[k]) if same is None else same & table[k].eqNullSafe(new[k])
    return table.join(new, same, "left_anti").unionByName(new.select(table.columns))


def without_references(rows: DataFrame, key: str, *referring: tuple[DataFrame, str]) -> DataFrame:
    """Rows that nothing refers to, which may be deleted."""
    for df, column in referring:
        rows = rows.join(df.select(F.col(column).alias(key)).distinct(), key, "left_anti")
    return rows


def created_quotes(rows: DataFrame, materials: DataFrame, thresholds: DataFrame) -> DataFrame:
    """New quotes of known materials with total, deviation and alert; a reference of 0 counts as missing."""
    from bidloom.functions.numbers import alert, deviation, line_total, rounded

    from .baseline import bounds

    m = materials.select(F.col("id").alias("material_id"), "category", "ref_price_reasonable_low", "ref_price_median")
    of = bounds(rows.join(m, "material_id"), thresholds)
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    dev = rounded(deviation(F.col("unit_price"), F.coalesce(nonzero("ref_price_reasonable_low"), nonzero("ref_price_median"))), 4)
    return of.withColumn("total_price", line_total(F.col("unit_price"), F.col("quantity"))).withColumn("deviation_pct", dev).withColumn("alert_level", alert(F.col("deviation_pct"), F.col("yellow"), F.col("red")))


def invited(chosen: list[int], suppliers: DataFrame, recommended: DataFrame, tender_id: int, existing: DataFrame) -> DataFrame:
    """A tender's invitations of the chosen suppliers that exist: those invited before stay as they are, new ones carry rank and score where they are recommended.

    tender_id, supplier_id, supplier_name, rank, score, status.
    """
    mine = suppliers.filter(F.col("id").isin(chosen)).select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name"))
    before = existing.filter(F.col("tender_id") == tender_id).select("supplier_id", F.struct("rank", "score", "status").alias("_b"))
    new = F.struct("rank", "score", F.lit("pending").alias("status"))
    out = mine.join(recommended.select("supplier_id", "rank", "score"), "supplier_id", "left").withColumn("_n", new).join(before, "supplier_id", "left")
    return out.select(F.lit(tender_id).cast("long").alias("tender_id"), "supplier_id", "supplier_name", F.coalesce("_b", "_n").alias("_i")).select("tender_id", "supplier_id", "supplier_name", "_i.rank", "_i.score", "_i.status")


def tenders_after(tenders: DataFrame, invitations: DataFrame) -> DataFrame:
    """Drafts with an invitation have become invited."""
    some = invitations.select(F.col("tender_id").alias("id")).distinct().withColumn("_some", F.lit(True))
    return tenders.join(some, "id", "left").withColumn("status", F.when(F.col("_some") & (F.col("status") == "draft"), "invited").otherwise(F.col("status"))).drop("_some")


def tenders_listed(tenders: DataFrame, invitations: DataFrame, most: int = 50) -> DataFrame:
    """The newest tenders with their numbers of items and invitations."""
    counts = invitations.groupBy(F.col("tender_id").alias("id")).agg(F.count("*").alias("invitation_count"))
    newest = tenders.orderBy(F.desc("created_at"), "id").limit(most)
    return newest.join(counts, "id", "left").select("id", "project_name", "status", F.greatest(F.size("items"), F.lit(0)).alias("item_count"), F.coalesce("invitation_count", F.lit(0)).alias("invitation_count"), "created_at")


def with_children(parents: DataFrame, children: DataFrame, key: str, child_columns: list[str]) -> DataFrame:
    """Parents with an array of their children, in the order of the children's columns."""
    nested = children.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*child_columns))).alias("items"))
    return parents.join(nested, "id", "left").withColumn("n_items", F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)))


def aligned(groups: DataFrame, items: DataFrame, status: str = "confirmed") -> tuple[DataFrame, DataFrame]:
    """Confirmed groups with nested items, and the quotes that their items exclude from plain rows."""
    live = groups.filter(F.col("status") == status)
    inside = items.join(live.select(F.col("id").alias("group_id")), "group_id", "left_semi")
    return with_children(live, inside, "group_id", ["id", "quote_id", "supplier_id", "action"]), inside.select("quote_id")
