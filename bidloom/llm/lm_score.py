"""Cross-entropy difference of documents under two matched n-gram models.

The target model is counted over the texts chosen as target, the background model over
all texts. Both share one vocabulary, have the same order (bigrams, smoothed by
unigrams) and the same smoothing, and the background's counts are scaled to the
target's size, so that a loss differs by content and not by amount. A document's own
counts are left out of both models when it is scored: it is never told by itself. Its
score is the mean over its bigrams of target loss minus background loss, in nats: the
lower, the more it is like the target.

Every word of every text is in the vocabulary: a word's symbol is its hash among
``SYMBOLS`` ones, so no word is set aside as unknown, and words that share a symbol are
counted as one. The table of single symbols has that fixed size and is broadcast. The
table of bigrams grows with the input and is never gathered. Documents are packed in
runs of symbols, which are saved. A run sends its documents' distinct bigrams to buckets
by their hash; a bucket counts each of its bigrams over all documents and answers every
run with what the others hold; the run turns the answers into losses. Bigrams that would
fill a bucket by themselves, the commonest ones, do not travel: at most ``HOT`` of them
are counted in tasks and looked up from a broadcast table. Every bigram with more than a
share of 1/HEAVY + 2/HOT of all is among them, so no bucket depends on one bigram. Nor
do those travel that no other document can hold.

Rules, by case: null text counts as empty; a text without words has 0 tokens, losses of
0 and score 0; a text of any length is read whole; ASCII capitals are folded, ASCII
punctuation parts words; repeated rows count and are scored each; without a target text
the target model is uniform over the symbols; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Saved, map_arrow, quoted

#: Symbols of the vocabulary; one more stands for a text's borders.
SYMBOLS = 1 << 20
BORDER = SYMBOLS
ALL = SYMBOLS + 1
#: Bigrams that are counted in tasks, at most; of a run of bigrams, those with a share of 1 / HEAVY are candidates.
HOT = 1 << 18
HEAVY = 1 << 18
#: Symbols of a run of documents.
RUN = 1 << 20
#: Bits of a bigram and of a symbol; a run has fewer texts than the rest of 63 bits can number.
KEY_BITS, SYMBOL_BITS = 41, 21
#: Bigrams of documents that a bucket holds on average.
BUCKET = 1 << 21
#: Tokens that the unigram model weighs in a bigram's context, and a symbol in a unigram's.
CONTEXT, CELL = 50.0, 0.5
#: ASCII capitals to small letters, ASCII marks and digits' separators to spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


class Symbols(dict):
    """Symbols of words, kept while there are not too many."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word) % SYMBOLS
        return found


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def symbols(text: str | None, known: Symbols) -> np.ndarray:
    found = words(text)
    return np.fromiter(map(known.__getitem__, found), np.int64, len(found))


def _batch(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _pieces(columns: dict[str, np.ndarray], rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(next(iter(columns.values()))), rows):
        yield _batch({k: c[at : at + rows] for k, c in columns.items()})


def planes(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(packed: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, -1).T).view(kind).ravel()


def runs(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str) -> DataFrame:
    """Documents packed in runs of ``RUN`` symbols: run, doc_id, chosen, size (one entry a document), symbols.

    chosen: whether ``labels`` marks the document with 1 in any row. What is joined with
    the labels are symbols, not texts.
    """

    def encoded(ids, texts):
        known = Symbols()
        yield {"doc_id": ids, "symbols": [planes(symbols(t, known).astype(np.int32)) for t in texts]}

    rows = map_arrow(docs.select(F.col(quoted(id_col)).cast("long"), quoted(text_col)), encoded, "doc_id long, symbols binary")
    chosen = labels.filter((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("chosen", F.lit(True))
    rows = rows.join(chosen.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.coalesce("chosen", F.lit(False)).alias("chosen"), "symbols")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, ([], [], []), 0

        def out() -> pa.RecordBatch:
            ids, chosen, found = held
            sizes = [len(x) for x in found]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([chosen], pa.list_(pa.bool_())), pa.array([sizes], pa.list_(pa.int32())), pa.array([planes(np.concatenate(found))], pa.binary())],
                ["run", "doc_id", "chosen", "size", "symbols"],
            )

        for batch in batches:
            for i, mine, found in zip(*(batch.column(k) for k in range(3)), strict=True):
                for values, x in zip(held, (i.as_py(), mine.as_py(), from_planes(found.as_py(), np.int32)), strict=True):
                    values.append(x)
                size += len(held[2][-1]) + 1
                if size >= RUN:
                    yield out()
                    number, held, size = number + 1, ([], [], []), 0
        if size:
            yield out()

    return rows.mapInArrow(packed, RUNS)


RUNS = "run long, doc_id array<long>, chosen array<boolean>, size array<int>, symbols binary"


class Run:
    """One run's documents: symbols of all texts, with the place of the text each belongs to; empty texts hold nothing."""

    def __init__(self, row: dict):
        self.sizes = np.array(row["size"], np.int64)
        self.chosen = np.array(row["chosen"], bool)
        self.found = from_planes(row["symbols"], np.int32).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and bigram, as first * ALL + second, borders included."""
        full = np.flatnonzero(self.sizes)
        rank = np.repeat(np.arange(len(full)), self.sizes[full])
        whole = np.full(len(self.found) + len(full) + 1, BORDER)
        whole[np.arange(len(self.found)) + rank + 1] = self.found
        return np.repeat(full, self.sizes[full] + 1), whole[:-1] * ALL + whole[1:]

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and symbol, each text's border once."""
        full = np.flatnonzero(self.sizes)
        return np.concatenate((self.doc, full)), np.concatenate((self.found, np.full(len(full), BORDER)))

    def distinct(self) -> tuple[np.ndarray, ...]:
        """Each text's distinct bigrams: text, bigram, how often it is there, and how often its first and its second symbol."""
        doc, key = self.bigrams()
        both, n = np.unique((doc << KEY_BITS) | key, return_counts=True)
        doc, key = both >> KEY_BITS, both & ((1 << KEY_BITS) - 1)
        of, symbol = self.single()
        single, m = np.unique((of << SYMBOL_BITS) | symbol, return_counts=True)
        count = lambda s: m[np.searchsorted(single, (doc << SYMBOL_BITS) | s)]
        return doc, key, n, count(key // ALL), count(key % ALL)


def each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Run]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield row, Run(row)


def counted(packed: DataFrame) -> DataFrame:
    """Counts of single symbols (key: -1 - symbol) and of bigrams that are common in some run: key, target, all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, ALL), np.int64)
        for _, run in each_run(batches):
            doc, symbol = run.single()
            table[0] += np.bincount(symbol[run.chosen[doc]], minlength=ALL)
            table[1] += np.bincount(symbol, minlength=ALL)
            keys, n = np.unique(run.bigrams()[1], return_counts=True)
            many = n >= max(2, n.sum() // HEAVY)
            yield from _pieces({"key": keys[many], "target": np.zeros(int(many.sum()), np.int64), "all": n[many].astype(np.int64)})
        used = np.flatnonzero(table[1])
        yield from _pieces({"key": -1 - used, "target": table[0, used], "all": table[1, used]})

    return packed.mapInArrow(each, "key long, target long, all long").groupBy("key").agg(F.sum("target").alias("target"), F.sum("all").alias("all"))


def common_bigrams(counts: DataFrame, most: int = HOT) -> np.ndarray:
    """At most ``most`` of the commonest candidates, sorted: whole levels of counts, so that nothing is ranked."""
    level = F.floor(F.log2("all") * 4)
    rows = counts.filter("key >= 0")
    lowest, so_far = None, 0
    for at, n in rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some 250 rows
        if (so_far := so_far + n) > most:
            break
        lowest = at
    if lowest is None:
        return np.empty(0, np.int64)
    return np.sort(rows.filter(level >= lowest).select("key").toArrow()["key"].to_numpy())


def table_of(rows: DataFrame, size: int) -> np.ndarray:
    """Counts as a table (2, size) from at most ``size`` rows (at, target, all)."""
    found, table = rows.toArrow(), np.zeros((2, size))
    at = found["at"].to_numpy()
    table[0, at], table[1, at] = found["target"].to_numpy(), found["all"].to_numpy()
    return table


def counts_of(packed: DataFrame, hot: np.ndarray) -> np.ndarray:
    """Counts of the bigrams ``hot`` over all texts: (2, len(hot))."""
    shared = packed.sparkSession.sparkContext.broadcast(hot)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        table = np.zeros((2, len(keys)), np.int64)
        for _, run in each_run(batches):
            doc, found = run.bigrams()
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            hit = keys[at] == found
            table[0] += np.bincount(at[hit & run.chosen[doc]], minlength=len(keys))
            table[1] += np.bincount(at[hit], minlength=len(keys))
        used = np.flatnonzero(table[1])
        yield from _pieces({"at": used, "target": table[0, used], "all": table[1, used]})

    if not len(hot):
        return np.zeros((2, 0))
    rows = packed.mapInArrow(each, "at long, target long, all long")
    return table_of(rows.groupBy("at").agg(F.sum("target").alias("target"), F.sum("all").alias("all")), len(hot))


class Model:
    """Counts of single symbols, and the losses of bigrams given their own counts."""

    def __init__(self, single: np.ndarray):
        self.single = single
        self.sizes = single.sum(axis=1)
        self.scale = (1.0, self.sizes[0] / self.sizes[1] if self.sizes.all() else 1.0)

    def loss(self, m: int, keys: np.ndarray, pair: np.ndarray, own: np.ndarray, own_first: np.ndarray, own_second: np.ndarray) -> np.ndarray:
        """Loss of bigrams under model ``m`` (0 target, 1 background), the document's own counts left out."""
        first, second = self.single[m, keys // ALL] - own_first, self.single[m, keys % ALL] - own_second
        unigram = (second * self.scale[m] + CELL) / (self.sizes[m] * self.scale[m] + CELL * ALL)
        return -np.log(((pair - own) * self.scale[m] + CONTEXT * unigram) / (first * self.scale[m] + CONTEXT))


def at_home(model: Model, hot: np.ndarray, keys: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bigrams of texts need no bucket: common ones, with their place, and lonely ones, of which no other text can hold one, since it holds no such symbol."""
    lonely = (model.single[1, keys // ALL] == first) | (model.single[1, keys % ALL] == second)
    if not len(hot):
        return np.zeros(len(keys), bool), lonely, np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
    return hot[at] == keys, lonely, at


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a run sends its bigrams, by bucket and bigram, and their buckets in that order."""
    bucket = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((keys, bucket))
    return order, bucket[order].astype(np.int32)


def exchanged(packed: DataFrame, model: Model, hot: np.ndarray, pairs: np.ndarray, buckets: int) -> DataFrame:
    """Losses of every document, from counts over all: doc_id, n_tokens, target_loss, background_loss."""
    shared = packed.sparkSession.sparkContext.broadcast((model, hot, pairs))

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, keys, _ = shared.value
        for row, run in each_run(batches):
            doc, key, n, first, second = run.distinct()
            common, lonely, _ = at_home(model, keys, key, first, second)
            rest = ~(common | lonely)
            doc, key, n = doc[rest], key[rest], n[rest].astype(np.int32)
            order, bucket = dealt(key, buckets)
            key, n, target = key[order], n[order], (n * run.chosen[doc])[order].astype(np.int32)
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(starts, [*starts[1:], len(bucket)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([row["run"]]), pa.array([bucket[a]]), *(pa.array([planes(x[a:b])], pa.binary()) for x in (key, n, target))], ["run", "bucket", "key", "n", "target"])

    def met(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        columns = [[from_planes(r[c], kind) for r in rows] for c, kind in (("key", np.int64), ("n", np.int32), ("target", np.int32))]
        ends = np.cumsum([len(k) for k in columns[0]])[:-1]
        key, n, target = map(np.concatenate, columns)
        _, at = np.unique(key, return_inverse=True)
        answers = [[planes(x) for x in np.split((np.bincount(at, weights=w)[at] - w).astype(np.int32), ends)] for w in (target, n)]
        return pa.table({"run": [r["run"] for r in rows], "bucket": pa.array([r["bucket"] for r in rows], pa.int32()), "target": pa.array(answers[0], pa.binary()), "all": pa.array(answers[1], pa.binary())})

    def resolved(mine: pa.Table, answers: pa.Table) -> pa.Table:
        model, keys, pairs = shared.value
        out: dict[str, list] = {"doc_id": [], "n_tokens": [], "target_loss": [], "background_loss": []}
        for row, run in each_run(mine.to_batches()):
            doc, key, n, first, second = run.distinct()
            common, lonely, at = at_home(model, keys, key, first, second)
            rest = np.flatnonzero(~(common | lonely))
            order, _ = dealt(key[rest], buckets)
            heard = sorted(answers.to_pylist(), key=lambda r: r["bucket"])
            out["doc_id"] += row["doc_id"]
            out["n_tokens"] += row["size"]
            for m, name, own in ((0, "target", run.chosen[doc].astype(np.int64)), (1, "all", np.ones(len(doc), np.int64))):
                pair = n * own  # the text's own count, then that of all
                pair[common] = pairs[m, at[common]]
                if heard:
                    pair[rest[order]] += np.concatenate([from_planes(r[name], np.int32) for r in heard])
                loss = n * model.loss(m, key, pair, n * own, first * own, second * own)
                mean = np.bincount(doc, weights=loss, minlength=len(run.sizes)) / (run.sizes + 1)
                out["target_loss" if m == 0 else "background_loss"] += np.where(run.sizes > 0, mean, 0.0).tolist()
        return pa.table([pa.array(out["doc_id"], pa.int64()), pa.array(out["n_tokens"], pa.int64()), pa.array(out["target_loss"], pa.float64()), pa.array(out["background_loss"], pa.float64())], names=list(out))

    answers = packed.mapInArrow(sent, "run long, bucket int, key binary, n binary, target binary").groupBy("bucket").applyInArrow(met, "run long, bucket int, target binary, all binary")
    return packed.groupBy("run").cogroup(answers.groupBy("run")).applyInArrow(resolved, "doc_id long, n_tokens long, target_loss double, background_loss double")


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document of ``docs``: doc_id, n_tokens, target_loss, background_loss, score; the target is what ``labels`` marks with 1."""
    packed = Saved(runs(docs, labels, label_col, id_col, text_col)).df
    counts = Saved(counted(packed))
    single = table_of(counts.df.filter("key < 0").select((-1 - F.col("key")).alias("at"), "target", "all"), ALL)
    hot = common_bigrams(counts.df)
    counts.delete()
    model, pairs = Model(single), counts_of(packed, hot)
    buckets = max(1, int(-(-(single[1].sum() - pairs[1].sum()) // BUCKET)))
    out = exchanged(packed, model, hot, pairs, buckets)
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
