"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent between 0 and
1, normalised. The exponent is bisected: the largest at which the weights' entropy
reaches a share of its maximum, or, if a source would be repeated too often at that
one, the smallest that keeps the limit. Each pass over the table of sources tries 31
exponents, which makes five halvings.

Weights are realised as budgeted block permutations. Every source is passed in an order
shuffled by a hash, anew in each pass, until its budget (weight times the total) is
used up: some whole passes, then the head of one more. Its tokens are spread evenly
over blocks of equal size, so that each block holds every source by its weight, and
within a block all documents are shuffled together. The total is the least at which
every source is passed once, so no document is left out.

Running sums are taken in three steps: within buckets of bounded size that a document's
hash picks, over the sums of runs of buckets, and over the runs, so a source with a
third of all rows is spread over many tasks.

Rules, by case: a null source is a source of its own; a document weighs its words plus
one (its end), so empty and null texts weigh one; a document that crosses the end of
the last, partial pass is not in it; rows that repeat an id and a text are ordered
together; ties in the hash go by id and weight; extra columns, whatever their names,
are ignored by ``schedule`` and kept by ``mixed``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Saved, quoted

#: Share of the greatest possible entropy that the weights reach, and passes at most.
ENTROPY = 0.9
REPEATS = 4.0
BLOCK_TOKENS = 1_000_000
BUCKET_TOKENS = 200_000
SEED = 17
TRIED = 31
PASSES = 5
#: Buckets that are summed in one window.
RUN = 4096


def source_key(column: str) -> Column:
    """A key without nulls; a null source differs from an empty one."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def weight_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"\S+")), F.lit(0)).cast("long") + 1


@dataclass
class Temperature:
    exponent: float
    norm: float  #: sum of all shares to the power of the exponent
    total: int  #: tokens of all sources
    budget: float  #: tokens of the mixture


def temperature(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> Temperature:
    """The exponent for ``sources`` (s, tokens)."""
    total, most, least, n = sources.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens"), F.count("*")).first()
    if not n:
        return Temperature(1.0, 1.0, 0, 0.0)
    share = F.col("tokens") / float(total)
    wanted = entropy * log(n)

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        of = sources.select(share.alias("p")).agg(*(f(F.pow("p", F.lit(a))) for a in exponents for f in (F.sum, lambda x: F.sum(x * F.log("p"))))).first()
        return list(zip(of[::2], of[1::2], strict=True))

    def enough(a: float, z: float, plogp: float) -> bool:
        """Whether the entropy at ``a`` reaches the wanted one; it falls as ``a`` grows."""
        return log(z) - a * plogp / z >= wanted

    def within(a: float) -> bool:
        """Whether the rarest source is repeated often enough only; repetition falls as ``a`` grows."""
        return (most / least) ** (1 - a) <= repeats

    def narrowed(low: float, high: float) -> float:
        for _ in range(PASSES):
            tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
            good = [a for a, (z, plogp) in zip(tried, sums(tried), strict=True) if enough(a, z, plogp)]
            low, high = max(good, default=low), min((a for a in tried if a not in good), default=high)
        return low

    ((z, plogp),) = sums([1.0])
    exponent = 1.0 if enough(1.0, z, plogp) else narrowed(0.0, 1.0)
    if not within(exponent):
        low, high = exponent, 1.0
        for _ in range(5 * PASSES):
            middle = (low + high) / 2
            low, high = (low, middle) if within(middle) else (middle, high)
        exponent = high
    ((z, _),) = sums([exponent])
    # The commonest source has the largest ratio of tokens to weight: passing it once passes all.
    return Temperature(exponent, z, total, total * z * (most / total) ** (1 - exponent))


def budgets(sources: DataFrame, t: Temperature) -> DataFrame:
    """s, tokens, weight, budget, passes (whole ones), rest (tokens of one more), buckets."""
    weight = F.pow(F.col("tokens") / float(max(1, t.total)), F.lit(t.exponent)) / t.norm
    return (
        sources.withColumn("weight", weight)
        .withColumn("budget", F.greatest("tokens", F.round(F.col("weight") * t.budget).cast("long")))
        .withColumn("passes", F.expr("budget div tokens").cast("int"))
        .withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
        .withColumn("buckets", F.ceil(F.col("tokens") / float(BUCKET_TOKENS)).cast("long"))
    )


def turn(one_pass: Column, doc_id: Column, weight: Column) -> Column:
    """A document's place in the order of a pass."""
    return F.xxhash64(F.lit(SEED), one_pass, doc_id, weight)


class Plan:
    """The order of all documents' passes over sources ``t`` (their budgets).

    ``keep`` names a column (a struct, say) that travels with the rows.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, entropy: float, repeats: float, keep: Column | None = None):
        source = quoted(source_col)
        rows = docs.select(
            F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), source_key(source).alias("s"), weight_of(quoted(text_col)).alias("w"), *([] if keep is None else [keep.alias("row")])
        )
        # Without a load, rows are small and saved; with one, the documents are read again.
        self.rows = Saved(rows).df if keep is None else rows
        sources = Saved(self.rows.groupBy("s").agg(F.sum("w").alias("tokens"))).df
        self.temperature = temperature(sources, entropy, repeats)
        self.sources = Saved(budgets(sources, self.temperature)).df

    def ordered(self) -> DataFrame:
        """Rows of every pass with ``before``: the tokens of the pass before them."""
        of = self.rows.join(self.sources, "s").withColumn("pass", F.explode(F.expr("sequence(0, passes - IF(rest > 0, 0, 1))")))
        of = of.withColumn("turn", turn(F.col("pass"), F.col("doc_id"), F.col("w")))
        # Buckets follow the order of turns.
        unit = F.shiftrightunsigned(F.col("turn").bitwiseXOR(F.lit(-(1 << 63))), 32) / float(1 << 32)
        of = of.withColumn("bucket", F.least(F.floor(unit * F.col("buckets")), F.col("buckets") - 1))
        sums = Saved(of.groupBy("s", "pass", "bucket").agg(F.sum("w").alias("filled"))).df
        # Running sums over buckets, and over runs of buckets, so that no source's buckets meet in one task.
        sums = sums.withColumn("run", F.expr(f"bucket div {RUN}"))
        over = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        runs = sums.groupBy("s", "pass", "run").agg(F.sum("filled").alias("whole"))
        runs = runs.select("s", "pass", "run", F.coalesce(F.sum("whole").over(over("s", "pass", "run")), F.lit(0)).alias("first"))
        start = F.coalesce(F.sum("filled").over(over("s", "pass", "run", "bucket")), F.lit(0))
        sums = sums.withColumn("start", start).join(runs, ["s", "pass", "run"]).select("s", "pass", "bucket", (F.col("start") + F.col("first")).alias("start"))
        inside = Window.partitionBy("s", "pass", "bucket").orderBy("turn", "doc_id", "w").rowsBetween(Window.unboundedPreceding, -1)
        rows = of.withColumn("inside", F.coalesce(F.sum("w").over(inside), F.lit(0))).join(sums, ["s", "pass", "bucket"])
        rows = rows.withColumn("before", F.col("start") + F.col("inside"))
        return rows.filter((F.col("pass") < F.col("passes")) | (F.col("before") + F.col("w") <= F.col("rest")))

    def dealt(self, block_tokens: int) -> DataFrame:
        """``ordered`` with each row's block and its sorting key within it."""
        blocks = max(1, int(-(-self.temperature.budget // block_tokens)))
        at = (F.col("pass") * F.col("tokens") + F.col("before")) / F.col("budget")
        return self.ordered().withColumn("block", F.least(F.floor(at * float(blocks)), F.lit(blocks - 1)).cast("long")).withColumn("key", F.xxhash64(F.lit(SEED + 1), "turn"))


ORDER = ("key", "doc_id", "pass", "w", "s")


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document and pass: doc_id, source, pass, block, place, n_tokens, weight (its source's)."""
    rows = Plan(docs, id_col, text_col, source_col, entropy, repeats).dealt(block_tokens)
    place = F.row_number().over(Window.partitionBy("block").orderBy(*ORDER)).alias("place")
    return rows.select("doc_id", "source", F.col("pass").cast("int"), "block", place, F.col("w").alias("n_tokens"), "weight")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", entropy: float = ENTROPY, repeats: float = REPEATS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` as ``schedule`` has them: every row as often as it is passed, each block whole in one partition and in its order.

    The texts are shuffled twice: to the buckets in which a pass is ordered, and to the blocks.
    """
    row = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    rows = Plan(docs, id_col, text_col, source_col, entropy, repeats, row).dealt(block_tokens)
    placed = rows.select("block", *ORDER, "row").repartition("block").sortWithinPartitions("block", *ORDER)
    return placed.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])
