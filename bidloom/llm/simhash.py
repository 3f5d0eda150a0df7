"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has one bit for each bit of the shingles' hashes: 1 if it is set in
over half of them. Two fingerprints that differ in at most ``2 * HALF`` bits have a
variant in common that differs from either in at most ``HALF`` bits. So every distinct
fingerprint emits all its variants (2,081 of them for two bits), rows meet on equal
variants, and the pairs that meet are deduplicated and verified.

Shuffling every variant by itself would move 2,081 rows a fingerprint. Variants are
shuffled on their leading bits instead: a fingerprint goes once to each bucket that
holds any of its variants (67 rows for eleven leading bits) and the variants in a bucket
are spelled out there, in numpy, and meet by sorting. The number of leading bits
follows the number of fingerprints. A bucket with too many variants (a dense group of
near copies) is cut by eight further bits, again and again; with all bits used, a
bucket is one variant and holds 2,081 fingerprints at most. Nothing is capped.

All that meet on a variant lie within the radius of each other, so a bucket returns a
spanning forest of its verified pairs, no more links than fingerprints; components
follow from alternating stars over all links.

Rules, by case: null text counts as empty; texts without words have fingerprint 0 and
are linked like any other; fewer words than a shingle make one shingle; shingles count
as often as they occur; repeated rows are returned each; a null id is never a
component's id unless all its ids are null; extra columns are ignored by ``linked``
and kept by ``one_of_each``; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Saved, joined_per_key, map_arrow
from .components import components

WORDS = 4
SEED = 42
HALF = 2
BITS = 64
#: Variants that a bucket may hold before it is cut, and those that it holds on average.
MOST = 1 << 21
USUAL = 1 << 18
FURTHER = 8
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
POWERS = 1 << np.arange(BITS, dtype=np.uint64)


def fingerprint(text: str | None, words: int = WORDS) -> int:
    found = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    shingles = max(1, len(found) - words + 1)
    cuts = map(slice, starts[:shingles].tolist(), (ends[min(words, len(found)) - 1 :] - 1).tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(SEED)), np.uint64, shingles)
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, shingles, 1 << 15):
        bits = np.unpackbits(hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(POWERS[2 * set_in > shingles].sum())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint as a signed long)."""

    def each(ids, texts):
        fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
        yield {"doc_id": ids, "fp": fps.tolist()}

    return map_arrow(docs.select(F.col(id_col).cast("long"), text_col), each, "doc_id long, fp long")


def masks(width: int, flips: int) -> list[int]:
    """All numbers of ``width`` bits with at most ``flips`` bits set."""
    return [sum(1 << k for k in c) for n in range(flips + 1) for c in combinations(range(width), n)]


def _ball(width: int, flips: int) -> int:
    return len(masks(width, flips))


def _to_buckets(rows: DataFrame, done: int, bits: int, half: int) -> DataFrame:
    """Rows (fp, bucket, left) with ``done`` leading bits settled, dealt to buckets of ``bits`` leading bits.

    left: how many bits a variant in the bucket may still differ in.
    """
    width = bits - done
    part = F.shiftrightunsigned("fp", BITS - bits)
    own = part if width == BITS else part.bitwiseAND(F.lit((1 << width) - 1))
    by_left = F.when(F.col("left") == half, F.array(*map(F.lit, masks(width, half))))
    for n in range(half):
        by_left = by_left.when(F.col("left") == n, F.array(*map(F.lit, masks(width, n))))
    dealt = rows.select("fp", "bucket", "left", own.alias("own"), F.explode(by_left).alias("flip"))
    bucket = F.shiftleft("bucket", width).bitwiseOR(F.col("own").bitwiseXOR(F.col("flip")))
    return dealt.select("fp", bucket.alias("bucket"), (F.col("left") - F.bit_count("flip")).cast("int").alias("left"))


def _met(bits: int, half: int):
    """Links of one bucket: its fingerprints' variants spelled out, met and verified."""
    low = BITS - bits
    flips = {n: np.array(masks(low, n), np.uint64) for n in range(half + 1)}

    def each(found: pd.DataFrame) -> pd.DataFrame:
        fps = found["fp"].to_numpy(np.int64).view(np.uint64)
        left = found["left"].to_numpy()
        head = np.uint64((int(found["bucket"].iloc[0]) << low) & (2**64 - 1)) if bits else np.uint64(0)
        base = head | (fps & np.uint64((1 << low) - 1))
        rows = [np.flatnonzero(left == n) for n in flips]
        variants = np.concatenate([(base[r][:, None] ^ flips[n][None, :]).ravel() for n, r in enumerate(rows)])
        ordered = np.sort(variants)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        empty = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if not len(twice):
            return empty
        place = np.searchsorted(twice, variants)
        hit = np.flatnonzero(twice[np.minimum(place, len(twice) - 1)] == variants)
        owners = np.concatenate([np.repeat(r, len(flips[n])) for n, r in enumerate(rows)])[hit]
        order = np.lexsort((owners, place[hit]))
        owners, place = owners[order], place[hit][order]
        first = np.concatenate(([True], place[1:] != place[:-1]))
        star = owners[np.maximum.accumulate(np.where(first, np.arange(len(owners)), 0))]
        pairs = np.unique(np.stack((star, owners), 1)[star != owners], axis=0)
        pairs = pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * half]
        if not len(pairs):
            return empty
        root = forest(len(fps), pairs)
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pd.DataFrame({"a": fps[child].view(np.int64), "b": fps[root[child]].view(np.int64)})

    return each


def forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n)
    while True:
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up


def links(fps: DataFrame, half: int = HALF, most: int = MOST, usual: int = USUAL) -> DataFrame:
    """Links (a, b) that connect all of ``fps`` (fp, distinct) that differ in at most ``2 * half`` bits."""
    spark = fps.sparkSession
    n = fps.count()
    out = spark.createDataFrame([], "a long, b long")
    if n < 2:
        return out
    bits = min(32, max(4, (n * _ball(BITS, half) // usual).bit_length()))
    rows = _to_buckets(fps.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(half).alias("left")), 0, bits, half)
    held = None
    while True:
        size = F.lit(1)
        for k in range(1, half + 1):
            size = F.when(F.col("left") == k, _ball(BITS - bits, k)).otherwise(size)
        full = rows.groupBy("bucket").agg(F.sum(size).alias("variants")).filter(F.col("variants") > most).select("bucket") if bits < BITS else None
        crowded = full is not None and not (full := Saved(full).df).isEmpty()
        calm = rows.join(full, "bucket", "left_anti") if crowded else rows
        # Each round's links and the rows of crowded buckets are saved: nothing is dealt or met twice.
        found = Saved(calm.groupBy("bucket").applyInPandas(_met(bits, half), "a long, b long")).df
        out = out.unionByName(found)
        if crowded:
            more = min(BITS, bits + FURTHER)
            now = Saved(_to_buckets(rows.join(full, "bucket", "left_semi"), bits, more, half))
        if held:
            held.delete()
        if not crowded:
            return out
        held, rows, bits = now, now.df, more


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, half: int = HALF) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint, component_id."""
    rows = Saved(fingerprints(docs, id_col, text_col, words)).df
    distinct = Saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))).df
    nodes = components(links(distinct.select("fp"), half))
    # Fingerprints without links are their own components.
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n"))
    least = nodes.join(distinct.select(F.col("fp").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("of_nodes"))
    roots = least.join(sizes, "root").join(distinct.select(F.col("fp").alias("root"), "least"), "root")
    roots = Saved(roots.select("root", F.least("of_nodes", "least").alias("component_id"), "n")).df
    far = joined_per_key(nodes, roots, ["root"], "n").select(F.col("node").alias("fp"), "component_id").unionByName(roots.select(F.col("root").alias("fp"), "component_id"))
    all_of = Saved(distinct.join(far, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "size")).df
    return joined_per_key(rows, all_of, ["fp"], "size").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the row of the smallest id of each component; rows that share an id stay or go together."""
    found = linked(docs, id_col, text_col)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["_kept_id"]), "left_semi")
