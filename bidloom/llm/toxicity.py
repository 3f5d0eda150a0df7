"""Toxicity by a linear classifier over character n-grams scaled by log-count ratios.

A text's features are the character n-grams it holds (present or not), hashed to a
fixed number of places. Each feature is scaled by its naive Bayes log-count ratio, how
much more often toxic texts hold it than others, and a logistic regression is fitted
on the scaled features.

The classifier is fitted on a bounded sample of labelled rows, ``PER_LABEL`` of each
label, drawn by a hash of the id. Their n-grams are counted by place in Spark; only the
``FEATURES`` places that tell most keep their ratio, and of each learned text only one
bit a feature reaches the driver: ``2 * PER_LABEL * FEATURES / 8`` bytes at most (2.6 MB),
however long the texts are. Every text is scored whole.

Rules, by case: null text counts as empty; an empty text gets the model's base score;
texts of any length are scored whole; rows without a label, an id or a text teach
nothing; every row of a repeated label teaches; with fewer than two labels to learn
from, all scores are 0; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, map_arrow
from .langid import held_out

ORDERS = (3, 4, 5, 6)
PLACES_LOG2 = 18
PLACES = 1 << PLACES_LOG2
#: Labelled rows of each label that the model learns from, at most.
PER_LABEL = 2500
#: An n-gram must be in so many of the learned texts.
LEAST_TEXTS = 4
#: A ratio must be so many of its standard errors from 0; so many features at most, those most of them away.
ERRORS = 4.0
FEATURES = 4096
ROUNDS = 150
PENALTY = 0.02
TOXIC_FROM = 0.3
GAP = re.compile(r"[\W\d_]+")
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD3A2646D], np.uint32)


def places(text: str | None) -> list[np.ndarray]:
    """The hashed place of every n-gram of a text, one array an order."""
    plain = f" {GAP.sub(' ', (text or '').lower()).strip()} "
    codes = np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), np.uint32)
    out, mixed = [], codes * FACTORS[0]
    for n in range(2, ORDERS[-1] + 1):
        if len(codes) < n:
            break
        mixed = mixed[:-1] + codes[n - 1 :] * FACTORS[n - 1]
        if n in ORDERS:
            h = mixed ^ (mixed >> np.uint32(15))
            h = h * np.uint32(0x2C1B3C6D + 2 * n)
            out.append(h >> np.uint32(32 - PLACES_LOG2))
    return out


def present(text: str | None, table: np.ndarray) -> np.ndarray:
    """``table`` (one flag a place) set to the n-grams a text holds."""
    table.fill(False)
    for found in places(text):
        table[found] = True
    return table


def sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int, folds: int, fold: int) -> DataFrame:
    """Rows to learn from: label, at (the places of the text's n-grams)."""
    known = labels.select(F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("_label")).filter("_label IN (0, 1) AND _i IS NOT NULL").filter(~held_out("_i", folds, fold))
    # A few rows more than wanted are drawn by their hash, so that the cut after it moves little.
    sizes = dict(map(tuple, known.groupBy("_label").count().collect()))
    uniform = F.pmod(F.xxhash64(F.lit(label_col), "_i"), F.lit(1 << 40)) / float(1 << 40)
    drawn = None
    for label in (0, 1):
        share = min(1.0, (1.1 * per_label + 100) / max(1, sizes.get(label, 0)))
        part = known.filter(F.col("_label") == label).filter(uniform <= share).orderBy(uniform, "_i").limit(per_label)
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most 2 * per_label rows, so they may be broadcast.
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL").join(F.broadcast(drawn), "_i")

    def each(ids, texts, marks):
        table = np.zeros(PLACES, bool)
        yield {"label": marks, "at": [np.flatnonzero(present(t, table)).astype(np.int32) for t in texts]}

    return map_arrow(rows.select("_i", "_text", "_label"), each, "label int, at array<int>")


def ratios(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Log-count ratios of the places that tell most: place, ratio; ``sizes``: texts by label."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, PLACES), np.int64)
        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            labels = np.repeat(batch.column(0).to_numpy(), lengths)
            places = batch.column(1).flatten().to_numpy()
            for label in (0, 1):
                table[label] += np.bincount(places[labels == label], minlength=PLACES)
        used = np.flatnonzero(table.any(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[0, used]), pa.array(table[1, used])], ["place", "c0", "c1"])

    # Places are counted in a table a task, then summed: PLACES rows a task at most.
    count = rows.select("label", "at").mapInArrow(counted, "place int, c0 long, c1 long").groupBy("place").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    rate = lambda c, label: (F.col(c) + 1) / F.lit(float(sizes.get(label, 0) + 2))
    ratio = F.log(rate("c1", 1) / rate("c0", 0))
    error = F.sqrt(1 / (F.col("c0") + 1) + 1 / (F.col("c1") + 1))
    told = count.filter(F.col("c0") + F.col("c1") >= LEAST_TEXTS).select("place", ratio.alias("ratio"), F.abs(ratio / error).alias("told"))
    return told.filter(F.col("told") >= ERRORS).orderBy(F.desc("told"), "place").limit(FEATURES).select("place", "ratio")


class Model:
    """Weight of every place, with the ratio in it, and the base score."""

    def __init__(self, weights: np.ndarray, base: float):
        self.weights, self.base = weights, base

    def score(self, text: str | None, table: np.ndarray) -> float:
        z = self.base + float(self.weights[present(text, table)].sum(dtype=np.float64))
        return 1 / (1 + float(np.exp(-np.clip(z, -500, 500))))


def regression(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and base of a logistic regression in which both labels weigh the same; x: (texts, features)."""
    w, base = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (y == 0).sum()))
    for t in range(1, ROUNDS + 1):
        z = base + x @ w.astype(np.float32)
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * weight
        g = np.append(error.astype(np.float32) @ x + PENALTY * w / max(1, len(w)), error.sum())
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        base -= step[-1]
    return w, float(base)


def fit(rows: DataFrame) -> Model | None:
    """The model of ``rows`` (label, at)."""
    held = Saved(rows)
    sizes = {label: n for label, n in held.df.groupBy("label").count().collect()}
    if len(sizes) < 2:
        held.delete()
        return None
    told = sorted(map(tuple, ratios(held.df, sizes).collect()))
    names = np.array([p for p, _ in told], np.int64)
    ratio = np.array([r for _, r in told], np.float32)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(names)

    def each(labels, at):
        bits = [np.packbits(np.isin(shared.value, np.asarray(a, np.int64))).tobytes() for a in at]
        yield {"label": labels, "bits": bits}

    found = map_arrow(held.df.select("label", "at"), each, "label int, bits binary").collect()
    held.delete()
    found.sort(key=lambda r: (r.label, bytes(r.bits)))  # the same model whatever the order of tasks
    y = np.array([r.label for r in found], np.float64)
    x = np.empty((len(found), len(names)), np.float32)
    for k, r in enumerate(found):
        x[k] = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), count=len(names)) * ratio
    w, base = regression(x, y)
    weights = np.zeros(PLACES, np.float32)
    weights[names] = ratio * w
    return Model(weights, base)


def learned(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, folds: int = 4, fold: int = 2) -> Model | None:
    return fit(sample(docs, labels, label_col, id_col, text_col, per_label, folds, fold))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # PLACES weights

    def each(ids, outs, texts):
        table, tool = np.zeros(PLACES, bool), shared.value
        scores = [tool.score(t, table) for t in texts] if tool else list(repeat(0.0, len(ids)))
        yield {"doc_id": ids, "held_out": outs, "score": scores, "predicted": [int(s >= TOXIC_FROM) for s in scores]}

    rows = docs.select(F.col(id_col).cast("long"), held_out(id_col, folds, fold), text_col)
    return map_arrow(rows, each, "doc_id long, held_out boolean, score double, predicted int")
