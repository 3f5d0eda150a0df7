"""Exact top-k inner products by aggregation without random access.

Candidates are dealt to blocks of bounded size, once each; queries are copied to every
block, where they pass by in a stream. A block keeps one list a component, sorted by
value. A query reads all its lists in step, each from the end that
adds most to its score, and never looks a candidate up: what it has read of a candidate
gives the score's lower bound (every component unread is the worst of its list) and
upper bound (every one unread is as good as the list's next). It stops when no candidate it has
not met can reach the k-th best lower bound and at most a share ``LEFT`` of the block
still can, and resolves the final scores of those. The bests of all blocks are merged by rank.

Rules, by case: components become floor(1024 * x); vectors that are null or hold null
or non-finite components take no part, nor do rows without an id; a query's candidates
are the vectors of its length, without those that carry its id; ties go to the smaller
id; repeated query rows are asked once, a repeated candidate row is read once and returned
each time; fewer candidates than k give all; an empty table gives an empty result; extra columns
are ignored. Scores are 64-bit integers; bounds are whole numbers too while their
absolute sums stay below 2^52, beyond that they carry the rounding's greatest error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 10
#: Rows of a block of candidates.
CANDIDATES = 8192
STEPS = 16
#: Candidates that may be left when a query stops reading: this share of its block.
LEFT = 1 / 8


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """The vectors that take part: id, v array<long>."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), doubles.alias("d"))
        .filter(~F.exists("d", bad))
        .select("id", F.transform("d", lambda x: F.floor(x * float(scale))).alias("v"))
    )


class Lists:
    """The sorted lists of a block of candidates."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        n, d = rows.shape
        order = np.argsort(rows, axis=0, kind="stable").T
        value = np.take_along_axis(rows.T, order, axis=1).astype(np.float64)
        self.up, self.up_value = np.ascontiguousarray(order), np.ascontiguousarray(value)
        self.down, self.down_value = np.ascontiguousarray(order[:, ::-1]), np.ascontiguousarray(value[:, ::-1])
        self.seen = np.zeros((n, d))
        #: The greatest absolute value of each list.
        self.most = np.maximum(np.abs(value[:, 0]), np.abs(value[:, -1]))
        #: Places of each list that the last query read.
        self.depth = 0

    def read(self, query: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From all lists the places ``start`` to ``end``: which component, which candidate, what it adds."""
        more, less = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        which = np.concatenate((self.down[more, start:end], self.up[less, start:end]))
        adds = np.concatenate((self.down_value[more, start:end] * query[more, None], self.up_value[less, start:end] * query[less, None]))
        return np.concatenate((more, less)), which, adds

    def best(self, query: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Candidates, without ``own``, among which the k best are."""
        n, d = self.rows.shape
        self.depth = 0
        allowed = np.ones(n, bool)
        allowed[own] = False
        if not query.any() or n - len(own) <= k:  # all tie, or all are among the k best
            return np.flatnonzero(allowed)
        self.seen.fill(0)
        flat = self.seen.reshape(-1)
        part = np.zeros(n)
        worst = self.read(query, n - 1, n)[2][:, 0]
        total = float(np.abs(query) @ self.most)
        slack = 0.0 if total < 2.0**52 else total * (d + 8) * 2.0**-51
        step = -(-n // STEPS)
        left = allowed
        for start in range(0, n, step):
            self.depth = end = min(n, start + step)
            lists, which, adds = self.read(query, start, end)
            part += np.bincount(which.ravel(), weights=adds.ravel(), minlength=n)
            flat[(which * d + lists[:, None]).ravel()] = 1
            following = adds[:, -1]
            if end < n and following.sum() >= part.max():  # lower bounds are below what was read: no stop yet
                continue
            table = np.zeros((d, 2))
            table[lists, 0], table[lists, 1] = following, worst
            read = self.seen @ table
            lower = np.where(allowed, part + worst.sum() - read[:, 1] - slack, -np.inf)
            upper = part + following.sum() - read[:, 0] + slack
            bar = np.partition(lower, n - k)[n - k]
            left = allowed & (upper >= bar)
            if following.sum() + slack < bar and left.sum() <= max(k, n * LEFT):
                break
        return np.flatnonzero(left)


SCHEMA = "query_id long, key long, vec_id long, copies int, score long"


def _answers(k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, candidates first."""
        at, rows, lists = None, [], None
        for batch in batches:
            n, b, asked, ids, key, copies = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n", "b", "asked", "id", "key", "copies"))
            cuts = np.flatnonzero((np.diff(n) != 0) | (np.diff(b) != 0) | (np.diff(asked.astype(int)) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(n)]):
                if hi == lo:
                    continue
                v = batch.column("v").slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, n[lo])
                if at != (n[lo], b[lo]):
                    at, rows, lists = (n[lo], b[lo]), [], None
                if not asked[lo]:
                    rows.append((ids[lo:hi], copies[lo:hi], v))
                    continue
                if rows and lists is None:
                    of_block, times, vectors = (np.concatenate(c) for c in zip(*rows))
                    lists = Lists(vectors)
                for q in range(lo, hi if rows else lo):
                    left = lists.best(v[q - lo], np.flatnonzero(of_block == ids[q]), k)
                    scores = lists.rows[left] @ v[q - lo]  # resolved: whole numbers
                    top = np.lexsort((of_block[left], -scores))[:k]
                    same = [np.full(len(top), x, np.int64) for x in (ids[q], key[q])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (*same, of_block[left][top], times[left][top].astype(np.int32), scores[top])],
                        names=["query_id", "key", "vec_id", "copies", "score"],
                    )

    return each


def search(vectors: DataFrame, queries: DataFrame, k: int = K, candidates: int = CANDIDATES) -> DataFrame:
    """Best ``k`` of ``vectors`` (id, v) for each of ``queries`` (id, v): query_id, rank, vec_id, score."""
    blocks = max(1, -(-vectors.count() // candidates))
    key, size = F.xxhash64("id", "v").alias("key"), F.size("v").alias("n")
    block = F.pmod("key", F.lit(blocks)).cast("int").alias("b")
    # Copies of a row are counted before they are dealt, so that no block outgrows its size; more than k are never returned.
    counted = vectors.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    rows = counted.select("id", "v", "copies", key, size, F.lit(False).alias("asked")).withColumn("b", block)
    to_each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    asked = queries.distinct().select("id", "v", F.lit(0).alias("copies"), key, size, F.lit(True).alias("asked"), to_each)
    dealt = rows.unionByName(asked).repartition(blocks, "n", "b").sortWithinPartitions("n", "b", "asked")
    found = dealt.mapInArrow(_answers(k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def of_table(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K) -> DataFrame:
    """``search`` with the rows whose id is divisible by ``every`` as queries."""
    rows = whole_vectors(vectors, id_col, vector_col)
    return search(rows, rows.filter(F.pmod("id", F.lit(every)) == 0), k)


ORACLE = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
