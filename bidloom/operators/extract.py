"""Extracted documents: merging of page results, clean-up, jobs, confirmation as quotes."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidloom.functions.numbers import alert, deviation, extraction_number, line_total, rounded, suggested_price
from bidloom.functions.text import first_category, tolerant_json

from .dashboard import first_by

#: Characters of a remark that are kept.
REMARK = 500

ITEM = "material string, spec string, brand string, unit string, qty string, unit_price string, total_price string, remark string"
QUOTE = f"supplier_name string, quote_date string, context map<string,string>, items array<struct<{ITEM.replace(' string', ':string')}>>"
TENDER_ITEM = "name:string,category:string,spec:string,unit:string,quantity:string,remark:string,attrs:map<string,string>"
TENDER = f"project_name string, project_code string, tender_date string, deadline string, items array<struct<{TENDER_ITEM}>>"
#: Of each kind of document: its schema, its scalars, and the fields by which two items are the same.
KINDS = {
    "quote": (QUOTE, ("supplier_name", "quote_date"), ("material", "spec", "qty")),
    "tender": (TENDER, ("project_name", "project_code", "tender_date", "deadline"), ("name", "spec", "quantity")),
}
PARTIAL = "data string, confidence double, tokens_used long, duration_ms long, error string"

#: What reads one page: its content to (JSON, confidence, tokens, milliseconds). External models fit here.
Provider = Callable[[Any], tuple[str, float, int, int]]
#: Pages that are read at once in a task.
IN_FLIGHT = 6


class Blocked(Exception):
    """A provider's refusal of what stands on a page; a part of it may pass."""


def halves_of_text(text: str) -> list[str]:
    """A page's text cut at the line break next to its middle, else in its middle; one character can't be cut."""
    middle = len(text) // 2
    cut = min((at for at in (text.rfind("\n", 0, middle) + 1, text.find("\n", middle) + 1) if 0 < at < len(text)), key=lambda at: abs(at - middle), default=middle)
    return [text[:cut], text[cut:]] if 0 < cut < len(text) else []


def page_parts(provider: Provider, content, halves: Callable[[Any], list], cuts: int, part: str = "") -> list[tuple]:
    """What a provider reads of a page, in order: (part, data, confidence, tokens, milliseconds, error).

    A blocked page is read again by halves, up to ``cuts`` times over; parts are named L
    and R along the way. What stays blocked, and what fails otherwise, keeps its error.
    """
    try:
        return [(part, *provider(content), None)]
    except Blocked as e:
        pieces = halves(content) if cuts > 0 else []
        if not pieces:
            return [(part, None, 0.0, 0, 0, f"blocked: {e}")]
        return [found for name, piece in zip("LR", pieces, strict=True) for found in page_parts(provider, piece, halves, cuts - 1, part + name)]
    except Exception as e:  # a page's failure is data here
        return [(part, None, 0.0, 0, 0, str(e))]


def pages_read(pages: DataFrame, provider: Provider, halves: Callable[[Any], list] = halves_of_text, cuts: int = 1, in_flight: int = IN_FLIGHT) -> DataFrame:
    """Every page (doc_id, page, content) through a provider: doc_id, page, part and ``PARTIAL``.

    A document's pages are read in one task, at most ``in_flight`` of them at once, and
    come out in their order. A failed page stops no other; a blocked one is read by
    halves, which ``halves`` cuts.
    """
    names = ["part", "data", "confidence", "tokens_used", "duration_ms", "error"]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            waiting: deque = deque()

            def oldest() -> pd.DataFrame:
                doc_id, page, parts = waiting.popleft()
                return pd.DataFrame([(doc_id, page, *p) for p in parts.result()], columns=["doc_id", "page", *names])

            for b in batches:
                for doc_id, page, content in zip(b["doc_id"], b["page"], b["content"]):
                    if len(waiting) == in_flight:
                        yield oldest()
                    waiting.append((doc_id, page, pool.submit(page_parts, provider, content, halves, cuts)))
            while waiting:
                yield oldest()

    kind = pages.schema["doc_id"].dataType.simpleString()
    ordered = pages.select("doc_id", F.col("page").cast("int").alias("page"), "content").repartition("doc_id").sortWithinPartitions("doc_id", "page")
    return ordered.mapInPandas(each, f"doc_id {kind}, page int, part string, {PARTIAL}")


def _skip(parts: bool):
    page = (lambda x: F.concat(x["page"]["number"], F.when(x["page"]["part"] != "", F.concat(F.lit("/"), x["page"]["part"])).otherwise(""))) if parts else lambda x: x["page"].cast("string")
    return lambda x: F.concat(F.lit("page"), page(x), F.lit("("), x["error"], F.lit(")"))


def merged(partials: DataFrame, kind: str = "quote") -> DataFrame:
    """One row a document from its pages: first non-empty scalars, items in order without repeats, sums, least confidence.

    partials: doc_id, page, data (JSON of a quote or a tender), confidence, tokens_used,
    duration_ms, and raw_text, part and error where there are such. With ``part``, a page's
    parts follow each other; with ``error``, ``skipped`` lists what could not be read and
    ``status`` is failed if that was everything. The JSON is parsed once and pages meet
    once; a quote takes over the first page's context that has one.
    """
    schema, scalars, key = KINDS[kind]
    raw = F.col("raw_text") if "raw_text" in partials.columns else F.lit(None).cast("string")
    place = F.struct(F.col("page").alias("number"), "part") if (parts := "part" in partials.columns) else F.col("page")
    # Parts that could not be read tell nothing but their error.
    told = F.col("error") if (failing := "error" in partials.columns) else F.lit(None).cast("string")
    rows = partials.select("doc_id", place.alias("page"), F.from_json("data", schema).alias("d"), F.when(told.isNull(), F.col("confidence")).alias("confidence"), "tokens_used", "duration_ms", raw.alias("raw_text"), told.alias("error"))
    first = lambda c: F.min(F.when(F.trim(F.col(f"d.{c}")) != "", F.struct("page", F.col(f"d.{c}").alias("v")))).v.alias(c)
    items = F.when(F.size("d.items") > 0, F.struct("page", F.col("d.items").alias("items")))
    # By page alone: maps inside have no order.
    in_order = lambda x: F.array_sort(x, lambda a, b: F.when(a["page"] < b["page"], -1).when(a["page"] > b["page"], 1).otherwise(0))
    texts = F.when(F.col("raw_text") != "", F.struct("page", "raw_text"))
    context = [F.min_by("d.context", F.when(F.size("d.context") > 0, F.col("page"))).alias("context")] if kind == "quote" else []
    out = rows.groupBy("doc_id").agg(
        *[first(c) for c in scalars], *context, F.sum("tokens_used").alias("tokens_used"), F.sum("duration_ms").alias("duration_ms"), F.min("confidence").alias("confidence"), (F.count_distinct("page.number") if parts else F.count("*")).alias("pages"),
        *([F.transform(in_order(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("page", "error")))), _skip(parts)).alias("skipped"), F.when(F.count_if(F.col("error").isNull()) > 0, "done").otherwise("failed").alias("status")] if failing else []),
        in_order(F.collect_list(items)).alias("_items"), in_order(F.collect_list(texts)).alias("_texts"), in_order(F.collect_list(F.struct("page", F.coalesce(F.size("d.items"), F.lit(0)).alias("n")))).alias("_sizes"),
    )
    all_items = F.flatten(F.transform("_items", lambda p: p["items"]))
    same = lambda x: F.concat_ws("\x01", *[F.coalesce(F.trim(x[c]), F.lit("")) for c in key])
    # The first item of each key, in order: keys are sorted with their places once; a list bound by a lambda is not built anew for each item.
    bound = lambda x, f: F.transform(F.array(x), f)[0]
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
    in_place = lambda keys: F.array_sort(F.transform(bound(F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))), firsts), lambda x: x["i"]))
    # Most documents repeat nothing and need no sort.
    kept = lambda x: F.when(F.size(F.array_distinct(x["keys"])) == F.size(x["keys"]), x["all"]).otherwise(F.transform(in_place(x["keys"]), lambda i: F.get(x["all"], i)))
    out = out.withColumn("items", bound(all_items, lambda a: bound(F.struct(a.alias("all"), F.transform(a, same).alias("keys")), kept)))
    out = out.withColumn("raw_text", F.array_join(F.transform("_texts", lambda p: p["raw_text"]), "\n---batch---\n")).withColumn("items_per_page", F.transform("_sizes", lambda p: F.greatest(p["n"], F.lit(0))))
    return out.drop("_items", "_texts", "_sizes")


def named_items(items: Column) -> Column:
    """Quote items but those without a name."""
    return F.filter(items, lambda x: F.coalesce(F.trim(x["material"]) != "", F.lit(False)))


def cleaned_items(items: Column) -> Column:
    """Quote items with numbers, trimmed names, computed totals; those without a name drop out."""
    texts, numbers = ("material", "spec", "brand", "unit"), ("qty", "unit_price", "total_price")
    # Each number is read once, then the total follows from them.
    read = F.transform(named_items(items), lambda x: F.struct(*[F.trim(x[c]).alias(c) for c in texts], *[extraction_number(x[c]).alias(c) for c in numbers], F.trim(x["remark"]).alias("remark")))
    return F.transform(read, lambda x: F.struct(*[x[c].alias(c) for c in (*texts, "qty", "unit_price")], line_total(x["unit_price"], x["qty"], x["total_price"]).alias("total_price"), x["remark"].alias("remark")))


def tender_items(items: Column) -> Column:
    """Tender items (name, category, spec, quantity, attrs): named ones, with a category inferred where none is given and empty attributes dropped."""
    typed = F.transform(
        items,
        lambda x: F.struct(
            F.trim(x["name"]).alias("name"), F.coalesce(F.when(F.trim(x["category"]) != "", x["category"]), first_category(x["name"])).alias("category"), F.trim(x["spec"]).alias("spec"),
            extraction_number(x["quantity"]).alias("quantity"), F.map_filter(x["attrs"], lambda k, v: v.isNotNull() & (F.trim(v) != "")).alias("attrs"),
        ),
    )
    return F.filter(typed, lambda x: F.coalesce(x["name"] != "", F.lit(False)))


def lines(documents: DataFrame) -> DataFrame:
    """One row an item of merged documents, with a suggestion where a unit price looks like a line total; prices stay as they are."""
    rows = documents.select("doc_id", "supplier_name", "quote_date", F.posexplode(cleaned_items(F.col("items"))).alias("pos", "i")).select("doc_id", "supplier_name", "quote_date", "pos", "i.*")
    return rows.withColumn("suggestion", suggested_price(F.col("unit_price"), F.col("qty"), F.col("total_price")))


def confirmed(
    rows: DataFrame, materials: DataFrame, thresholds: DataFrame, done: DataFrame, tiers: DataFrame, category: str, supplier_id: int | None = None, project_id: int | None = None, bid_status: str = ""
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirmed lines (job_id, pos, material, spec, brand, unit, qty, unit_price, total_price, remark) as quotes, the materials they need first, and the unknown brands.

    A batch (the job's first eight characters and the supplier) that is in ``done`` is
    left out: confirming twice adds nothing. Lines without a name are skipped. The
    material must agree in category, standard name and specification; the tier is the
    brand's in any category; deviation and alert follow the material's reference price.
    """
    from .baseline import bounds, with_tier
    from .ingest import with_standard_names

    batch = F.concat_ws("-", F.lit("OCR"), F.substring("job_id", 1, 8), F.lit(str(supplier_id) if supplier_id else "nos"))
    named = rows.filter(F.trim("material") != "").withColumn("name", F.trim("material")).withColumn("batch_id", batch).join(done.select("batch_id").distinct(), "batch_id", "left_anti")
    lines = with_standard_names(named).withColumn("spec", F.coalesce(F.trim("spec"), F.lit(""))).withColumn("brand", F.coalesce(F.trim("brand"), F.lit("")))
    own = materials.filter(F.col("category") == category).groupBy("standard_name", F.coalesce("spec", F.lit("")).alias("spec")).agg(
        F.min("id").alias("material_id"), *[F.min_by(c, "id").alias(c) for c in ("ref_price_reasonable_low", "ref_price_median")]
    )
    known = lines.join(own, ["standard_name", "spec"], "left")
    fresh = known.filter("material_id IS NULL").groupBy("standard_name", "spec").agg(F.min_by("unit", "pos").alias("unit"), F.min_by("brand", "pos").alias("brand")).withColumn("category", F.lit(category))
    tiered = with_tier(known, tiers.groupBy("brand_name").agg(F.min("tier").alias("tier")).withColumn("category", F.lit(None).cast("string")), by_category=False)
    nonzero = lambda c: F.when(F.col(c) != 0, F.col(c))
    dev = rounded(deviation(F.col("unit_price"), F.coalesce(nonzero("ref_price_reasonable_low"), nonzero("ref_price_median"))), 4)
    priced = bounds(tiered.withColumn("category", F.lit(category)).withColumn("deviation_pct", dev), thresholds)
    quotes = priced.select(
        "material_id", "standard_name", "spec", F.lit(supplier_id).cast("long").alias("supplier_id"), F.lit(project_id).cast("long").alias("project_id"), "unit_price", F.col("qty").alias("quantity"),
        line_total(F.col("unit_price"), F.col("qty"), F.col("total_price")).alias("total_price"), "brand", F.coalesce("tier", F.lit("")).alias("brand_tier"), F.substring("remark", 1, REMARK).alias("remark"), "batch_id",
        F.lit(bid_status).alias("bid_status"), "deviation_pct", F.when(F.col("deviation_pct").isNull(), "").otherwise(alert(F.col("deviation_pct"), F.col("yellow"), F.col("red"))).alias("alert_level"),
    )
    unknown = tiered.filter("brand <> '' AND tier IS NULL").select("brand").distinct()
    return quotes, fresh, unknown


def latest_job(jobs: DataFrame) -> DataFrame:
    """Of each file, type and context the newest job that has not failed: uploads of the same bytes come back to it."""
    live = jobs.filter("status <> 'failed'").withColumn("_age", -F.unix_micros(F.col("created_at").cast("timestamp")))
    return first_by(live, ["file_hash", "type", "context"], ["_age", "id"]).select(*jobs.columns)


#: What of a job's context tells uploads of the same bytes apart, by name; ids are numbers.
CONTEXT_KEYS = ("category", "project_id", "supplier_id")


def context_hash(context: Column) -> Column:
    """16 hex digits of the JSON of what a context map says of the category, project and supplier; 'noctx' if nothing.

    The JSON has the keys in order, a blank after each comma and colon, ids that are whole
    numbers bare, and letters as they are.
    """
    quoted = lambda v: F.regexp_extract(F.to_json(F.array(v)), r"(?s)^\[(.*)\]$", 1)
    bare = lambda k, v: F.when(v.rlike("^(0|-?[1-9][0-9]*)$") & F.lit(k.endswith("_id")), v).otherwise(quoted(v))
    said = [F.when(F.element_at(context, k) != "", F.concat(F.lit(f'"{k}": '), bare(k, F.element_at(context, k)))) for k in CONTEXT_KEYS]
    whole = F.concat_ws(", ", *said)
    return F.when(F.coalesce(whole, F.lit("")) == "", "noctx").otherwise(F.substring(F.sha2(F.concat(F.lit("{"), whole, F.lit("}")), 256), 1, 16))


ALIGNMENT = "groups array<struct<suggested_name:string,suggested_spec:string,confidence:string,reason:string,items:array<struct<quote_id:bigint,supplier_id:bigint,action:string>>>>, field_fixes array<struct<quote_id:string,field:string,current:double,suggested:double,confidence:string,reason:string>>"


def alignment_response(replies: DataFrame, column: str = "reply") -> DataFrame:
    """A model's replies (id, reply) as groups and fixes: groups need a name and items, fixes a quote; missing texts are '', missing confidences 0, a missing field unit_price."""
    parsed = F.from_json(tolerant_json(F.col(column)), ALIGNMENT)
    number = lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0))
    text = lambda x: F.coalesce(x, F.lit(""))
    groups = F.transform(
        F.filter(parsed.groups, lambda g: g["suggested_name"].isNotNull() & g["items"].isNotNull()),
        lambda g: F.struct(g["suggested_name"].alias("suggested_name"), text(g["suggested_spec"]).alias("suggested_spec"), number(g["confidence"]).alias("confidence"), text(g["reason"]).alias("reason"), g["items"].alias("items")),
    )
    fixes = F.transform(
        F.filter(parsed.field_fixes, lambda x: x["quote_id"].try_cast("long").isNotNull()),
        lambda x: F.struct(x["quote_id"].try_cast("long").alias("quote_id"), F.coalesce(x["field"], F.lit("unit_price")).alias("field"), x["current"].alias("current"), x["suggested"].alias("suggested"), number(x["confidence"]).alias("confidence"), text(x["reason"]).alias("reason")),
    )
    return replies.select("id", groups.alias("groups"), fixes.alias("field_fixes")).withColumn("n_groups", F.greatest(F.size("groups"), F.lit(0))).withColumn("n_fixes", F.greatest(F.size("field_fixes"), F.lit(0)))


def swept(jobs: DataFrame, now: str, minutes: int = 5) -> DataFrame:
    """Running jobs that were not touched for so long have failed."""
    stuck = (F.col("status") == "running") & (F.col("updated_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return jobs.withColumn("status", F.when(stuck, "failed").otherwise(F.col("status")))


def job_states(events: DataFrame) -> DataFrame:
    """Each job's state from its events (job_id, at, status, progress): the last status, the greatest progress."""
    return events.groupBy("job_id").agg(F.max(F.struct("at", "status")).status.alias("status"), F.max("progress").alias("progress"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"), F.count("*").alias("events"))


def jobs_listed(jobs: DataFrame, kind: str | None = None, status: str | None = None, most: int = 50) -> DataFrame:
    """Jobs of a type and status, the newest first."""
    for column, value in (("type", kind), ("status", status)):
        jobs = jobs.filter(F.col(column) == value) if value else jobs
    return jobs.orderBy(F.desc("created_at"), "id").limit(most)


def retried(uploads: DataFrame, jobs: DataFrame) -> DataFrame:
    """Uploads (file_hash, type, context) that need a new job: those without one that has not failed."""
    keys = ["file_hash", "type", "context"]
    return uploads.dropDuplicates(keys).join(jobs.filter("status <> 'failed'").select(*keys), keys, "left_anti")


def page_batches(pages: Column, size: int, shared: bool = True) -> Column:
    """Pages in batches of ``size``; each further batch repeats the first page as context."""
    starts = F.when(F.size(pages) > 0, F.sequence(F.lit(0), F.size(pages) - 1, F.lit(size)))
    first = F.slice(pages, 1, 1)
    return F.transform(starts, lambda n: F.when((n > 0) & F.lit(shared), F.concat(first, F.slice(pages, n + 1, size))).otherwise(F.slice(pages, n + 1, size)))
