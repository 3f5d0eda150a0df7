"""Ranked lexical search over an index in tiers, with proof of exactness.

The index. Documents are packed in runs of some ``RUN`` terms; the index has one row a
run. It holds the run's documents, its terms with the number of its documents that have
them, and posting lists: a posting is a document's place in its run and how much the
term's frequency counts there. By its impact (that number by the term's weight, as the
run sees it) a posting goes to one of the tiers, high impacts first. Each tier is a group
of columns, so a scan of high tiers does not read the lower ones. Of every term the row
knows, for each tier, the greatest count further down, from which residual bounds follow.

The search. A round reads the tiers down to its own and sums, for every document of a
run, what an item's terms add: the score's lower bound. The residual bounds of those of
the item's terms that were not met in the document give the upper bound. An item is
proven when the k documents with the greatest upper bounds have no gap between their
bounds: nothing else can pass them, and their scores are known. Items that lack this
proof fall through to the next tier, but only in runs where some document's upper bound
reaches the k-th best lower bound of all runs. In the last tier nothing remains below, so
every item ends there at the latest. In which tier a posting is, is a matter of speed
alone: the bounds come from the true weights, which count all documents.

No posting is shuffled: what leaves a run is at most 2 k documents an item. Items are
asked in batches of about ``BATCH`` different terms, whose table is broadcast.

Rules, by case: null text has no terms; documents without terms are not counted and never
found; texts of any length are read whole (a longer one is a run by itself); repeated rows
are documents of their own; ties go to the smaller id, rows without an id come last;
items without terms, or without a document, have no rows; items equal in id and text are
asked once; a null item id is an id; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Saved, quoted

K = 10
#: Terms of a run, repeats included.
RUN = 1 << 16
#: Different pairs of item and term of a batch of items, about.
BATCH = 1 << 18
#: Documents of a run, at most: their places take two bytes.
MOST_DOCS = (1 << 16) - 1
#: How the index is written: small row groups, of which a task holds one at a time; packed numbers don't repeat as values.
WRITTEN = {"parquet.block.size": 4 << 20, "parquet.enable.dictionary": "false"}
#: Greatest counts are kept in steps of so much, rounded up: in one byte, and bounds stay bounds.
STEP = 4096
#: Impacts that open the first tiers, as shares of the greatest possible one.
CUTS = (1 / 4, 1 / 16)
#: What is part of a term: digits, letters, all beyond ASCII. Only A-Z are folded.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
#: Scale of weights and of what a frequency counts, the length's share in hundredths, saturation: fixed values.
WEIGHT, COUNTS, LENGTH, SATURATION = 1000, 1_000_000_000, 75, 8


def term_list(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def lengths(n, docs: int, terms: int):
    """A document's m from its number of terms."""
    return 100 - LENGTH + (LENGTH * n * docs) // max(terms, 1)


def packed(values: np.ndarray, kind: type) -> bytes:
    return values.astype(kind).tobytes()


def unpacked(value: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(value, kind)


#: Of a tier's columns (how many postings each term has, their documents, their counts) the kinds of number.
KINDS = {"sizes": np.uint16, "docs": np.uint16, "counts": np.int32}


def tier_columns(tier: int) -> list[str]:
    return [f"{c}{tier}" for c in KINDS]


class Run:
    """Documents whose terms are gathered to a row of the index."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.found: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, terms: list[bytes]) -> None:
        known = self.known
        self.ids.append(doc_id)
        self.found.append(np.fromiter((known.setdefault(t, len(known)) for t in terms), np.int32, len(terms)))
        self.size += len(terms)

    def row(self, number: int, docs: int, terms: int, cuts: tuple[float, ...]) -> dict:
        own, vocabulary = len(self.ids), len(self.known)
        n = np.array([len(x) for x in self.found], np.int64)
        key, tf = np.unique(np.concatenate(self.found).astype(np.int64) * own + np.repeat(np.arange(own), n), return_counts=True)
        term, doc = key // own, key % own
        counts = (COUNTS * tf) // (WEIGHT * tf + SATURATION * lengths(n[doc], docs, terms))
        df = np.bincount(term, minlength=vocabulary)
        weights = np.log((2 * own + 2) / (2 * df + 1))
        share = weights[term] * counts / (np.log((2 * own + 2) / 3) * COUNTS / WEIGHT)
        tier = sum(((share < c).astype(int) for c in cuts), np.ones(len(share), int))
        out = {"run": number, "ids": self.ids, "terms": b"\n".join(self.known), "df": packed(df, np.uint16)}
        tops = np.zeros((len(cuts) + 1, vocabulary), np.int64)
        for t in range(1, len(cuts) + 2):
            at = tier == t
            np.maximum.at(tops[t - 1], term[at], counts[at])
            columns = np.bincount(term[at], minlength=vocabulary), doc[at], counts[at]
            out |= {name: packed(x, kind) for name, x, kind in zip(tier_columns(t), columns, KINDS.values())}
        below = [-(-tops[t:].max(axis=0) // STEP) for t in range(1, len(cuts) + 1)]
        return out | {"below": b"".join(packed(x, np.uint8) for x in below)}


def _runs(docs: int, terms: int, run_size: int, cuts: tuple[float, ...], schema: pa.Schema):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, run = TaskContext.get().partitionId(), 0, Run()

        def out() -> pa.RecordBatch:
            row = run.row(part << 32 | number, docs, terms, cuts)
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in schema], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                if found := term_list(text.as_py()):
                    run.add(doc_id.as_py(), found)
                    if run.size >= run_size or len(run.ids) == MOST_DOCS:
                        yield out()
                        number, run = number + 1, Run()
        if run.ids:
            yield out()

    return each


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [len(term_list(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array([sum(x > 0 for x in n)], pa.int64()), pa.array([sum(n)], pa.int64())], names=["docs", "terms"])


@dataclass
class Index:
    """The index, in the shared folder, its documents and its tiers."""

    table: Saved
    docs: int
    tiers: int

    def delete(self) -> None:
        self.table.delete()


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_size: int = RUN, cuts: tuple[float, ...] = CUTS) -> Index:
    """The index of all documents, in two scans: the first counts documents and terms."""
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    total = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("docs", "terms")]).first()
    tiers = len(cuts) + 1
    columns = ["terms", "df", "below", *[c for t in range(1, tiers + 1) for c in tier_columns(t)]]
    schema = "run long, ids array<long>, " + ", ".join(f"{c} binary" for c in columns)
    arrow = pa.schema([("run", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in columns]])
    return Index(Saved(rows.mapInArrow(_runs(*total, run_size, cuts, arrow), schema), options=WRITTEN), total[0], tiers)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each item's terms and how often it has them: item_id, item (a digest of id and text), term, times."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    text = F.translate(F.col(quoted(text_col)), capitals, capitals.lower())
    rows = items.select(F.col(quoted(id_col)).cast("long").alias("item_id"), text.alias("text")).distinct()
    rows = rows.select("item_id", F.sha2(F.to_json(F.struct("item_id", "text")), 256).alias("item"), F.explode(F.regexp_extract_all("text", F.lit(f"({TERM})"))).alias("term"))
    return rows.groupBy("item_id", "item", "term").agg(F.count("*").alias("times"))


def _frequencies(sent):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents have each wanted term."""
        wanted = sent.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, df in zip(batch.column("terms"), batch.column("df")):
                here, own = places(terms.as_py(), wanted)
                total[here] += unpacked(df.as_py(), np.uint16)[own]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["t", "df"])

    return each


def places(terms: bytes, wanted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The wanted terms of a run: their numbers, and their places in the run."""
    found = [(t, k) for k, term in enumerate(terms.split(b"\n")) if (t := wanted.get(term)) is not None]
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


FOUND = "q int, run long, doc_id long, lower long, upper long"


def _bounded(sent, tier: int, tiers: int, k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run, for each item: the documents with the k greatest upper and the k greatest lower bounds."""
        wanted, weights, asked = sent.value
        for batch in batches:
            for k_th in range(batch.num_rows):
                row = {name: batch.column(name)[k_th].as_py() for name in batch.schema.names}
                yield from of_run(row, wanted, weights, asked)

    def of_run(row: dict, wanted: dict[bytes, int], weights: np.ndarray, asked: list[list[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        n = len(row["ids"])
        ids = pa.array(row["ids"], pa.int64())
        order = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        cut = [tuple(unpacked(row[c], kind) for c, kind in zip(tier_columns(t), KINDS.values())) for t in range(1, tier + 1)]
        cut = [(np.append(0, np.cumsum(sizes, dtype=np.int64)), docs, counts) for sizes, docs, counts in cut]
        vocabulary = len(cut[0][0]) - 1
        below = unpacked(row["below"], np.uint8)[(tier - 1) * vocabulary : tier * vocabulary].astype(np.int64) * STEP if tier < tiers else np.zeros(vocabulary, np.int64)
        # A term's list is cut by tiers, so a document meets it once at most.
        lists = {}
        for t, own in zip(*places(row["terms"], wanted)):
            docs = np.concatenate([d[s[own] : s[own + 1]] for s, d, _ in cut])
            lists[t] = docs, np.concatenate([c[s[own] : s[own + 1]] for s, _, c in cut]) * weights[t], below[own] * weights[t]

        def best(by: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(by >= np.partition(by, n - k)[n - k]) if n > k else np.arange(n)
            return at[np.lexsort((order[at], -by[at]))[:k]]

        out: list[tuple] = []
        for q in row.get("items") or range(len(asked)):
            lower, met, rest = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            for t, times in asked[q]:
                if t in lists:
                    docs, adds, left = lists[t]
                    lower[docs] += times * adds
                    if left:
                        rest += times * left
                        met[docs] += times * left
            upper = lower + (rest - met)
            kept = np.union1d(best(upper), best(lower)) if rest else best(upper)
            kept = kept[upper[kept] > 0]
            out.append((np.full(len(kept), q, np.int32), kept, lower[kept], upper[kept]))
        if out:
            q, kept, lower, upper = map(np.concatenate, zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), row["run"])), ids.take(pa.array(kept)), pa.array(lower), pa.array(upper)], names=["q", "run", "doc_id", "lower", "upper"])

    return each


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k rows of each item with the greatest upper bounds, with their rank."""
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _batch(spark: SparkSession, index: Index, terms: DataFrame, k: int) -> DataFrame | None:
    """Answers of one batch of items; None if it has none."""
    rows = terms.collect()
    items = sorted({(r.item_id is not None, r.item_id or 0, r.item) for r in rows})
    if not items or not index.docs:
        return None
    q_of = {item: q for q, (_, _, item) in enumerate(items)}
    t_of = {term: t for t, term in enumerate(dict.fromkeys(r.term.encode() for r in rows))}
    asked: list[list[tuple[int, int]]] = [[] for _ in items]
    for r in rows:
        asked[q_of[r.item]].append((t_of[r.term.encode()], r.times))
    counted = index.table.df.select("terms", "df").mapInArrow(_frequencies(spark.sparkContext.broadcast(t_of)), "t long, df long").groupBy("t").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(t_of), np.int64)
    for r in counted.select("t", weight(F.col("df"), index.docs).alias("w")).collect():
        weights[r.t] = r.w
    sent = spark.sparkContext.broadcast((t_of, weights, asked))
    open_items, pairs, answers = range(len(items)), None, []
    for tier in range(1, index.tiers + 1):
        runs = index.table.df.select("run", "ids", "terms", "below", *[c for t in range(1, tier + 1) for c in tier_columns(t)])
        runs = runs if pairs is None else runs.join(pairs, "run")
        found = Saved(runs.mapInArrow(_bounded(sent, tier, index.tiers, k), FOUND)).df
        gap = F.max((F.col("lower") < F.col("upper")).cast("int"))
        lacking = [r.q for r in _ranked(found, k).groupBy("q").agg(gap.alias("gap")).filter("gap = 1").collect()] if tier < index.tiers else []
        proven = sorted(set(open_items) - set(lacking))
        ends = spark.createDataFrame([(q, items[q][1] if items[q][0] else None) for q in proven], "q int, item_id long")
        answers.append(_ranked(found, k).join(F.broadcast(ends), "q").select("item_id", "rank", "doc_id", F.col("lower").alias("score"), F.lit(tier).alias("tier")))
        if not lacking:
            break
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lower")))
        bar = {r.q: r.lower for r in found.select("q", "lower", nth.alias("nth")).filter(F.col("nth") <= k).filter(F.col("nth") == k).collect()}
        bars = spark.createDataFrame([(q, bar.get(q, 0)) for q in lacking], "q int, bar long")
        reaching = found.join(F.broadcast(bars), "q").groupBy("run", "q").agg(F.max(F.col("upper") - F.col("bar")).alias("over")).filter("over >= 0")
        open_items, pairs = lacking, Saved(reaching.groupBy("run").agg(F.collect_list("q").alias("items"))).df
    return reduce(DataFrame.unionByName, answers)


def weight(df: Column, docs: int) -> Column:
    """A term's weight by its documents."""
    return F.floor(F.log((2.0 * docs + 2) / (2 * df + 1)) * WEIGHT)


def search(index: Index, items: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """Best ``k`` documents of each item: item_id, rank, doc_id, score and the tier in which they were proven."""
    spark = items.sparkSession
    terms = Saved(item_terms(items, id_col, text_col))
    batches = max(1, -(-terms.df.count() // batch))
    answers = None
    for b in range(batches):
        found = _batch(spark, index, terms.df.filter(F.pmod(F.xxhash64("item"), F.lit(batches)) == b), k)
        answers = found if answers is None else answers if found is None else answers.unionByName(found)
    terms.delete()
    return answers if answers is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), docs AS (SELECT d, doc_id, w, len(w) AS n FROM words WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
asked AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)),
terms AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(w) AS term FROM asked) GROUP BY ALL),
postings AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM postings, total GROUP BY term),
impacts AS (
  SELECT d, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))) AS impact
  FROM postings JOIN docs USING (d) JOIN weights USING (term), total
), scores AS (SELECT item_id, d, sum(times * impact)::BIGINT AS score FROM terms JOIN impacts USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores JOIN docs USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
