"""Language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent layer runs over the bytes of a text from the left, one from the
right; a linear layer on both states labels every position. A document's probability
of a language is the mean over the positions that hold letters. The network is
trained here, in numpy, by backpropagation through time.

The model is fitted on a bounded sample: ``TRAIN_WINDOWS`` pieces of at most
``TRAIN_BYTES`` bytes (``LEAST_PIECES`` a language, if that is more), drawn by a hash of
the id so that every language weighs the same, whatever its share of the rows, each
from a place of its text that the hash picks too. Every text is scored whole: it is cut
into pieces of ``WINDOW`` bytes, each position of each piece is labelled once. The states
start anew in each piece, and a piece may part the bytes of one character, so a letter
near a cut is labelled with less context than others.

Rules, by case: a text that is null or holds no letter gets ``und`` and score 0; a
text of any length is scored whole; rows with a null language, null text or null id
teach nothing; repeated rows are scored each; with no row to learn from, every
prediction is ``und``; the network has one output a language, however many there are;
an empty table gives an empty result; extra columns, whatever their names, are ignored
by ``predicted`` and kept by ``accepted``.

``accepted`` fits its network with one class more, "no language", which learns from
made-up texts with letters but without a language (``junk_pieces``). A text goes if it
holds no letter or if the mean probability of that class is above a bound, which is
calibrated on held-out labelled texts: at least 0.5, and so high that hardly any of
them go. The fewer texts it is told from, the nearer to 1 it is; with none, or with
nothing to learn from, every text with a letter stays. The rule holds for any number of
languages, one included.
"""

from __future__ import annotations

import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

HIDDEN = 8
WINDOW = 128
TRAIN_WINDOWS = 2400
TRAIN_BYTES = 96
BATCH = 256
STEPS = 160
RATE = 0.02
#: Pieces that are scored side by side; their states stay in the processor's cache.
SIDE_BY_SIDE = 1536
#: Pieces of each language at least, however many there are.
LEAST_PIECES = 20
PAD = 256
WORDLY = re.compile(r"[^\W\d_]")
#: Bytes that are ASCII letters or part of a longer UTF-8 sequence.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)] + [False])


def has_letter(text: str | None) -> bool:
    """Whether a text holds a letter (Unicode's L classes; ½, ² and Ⅷ are numbers)."""
    return any(m[0].isalpha() for m in WORDLY.finditer(text or ""))


class Network:
    """Weights, with the two directions along the first axis: inputs (2, 3H, 257), recurrent (2, 3H, H), output (C, 2H) and bias (C, 1)."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.inputs = rng.normal(0, 0.3, (2, 3 * hidden, 257)).astype(np.float32)
        self.recurrent = rng.normal(0, hidden**-0.5, (2, 3 * hidden, hidden)).astype(np.float32)
        self.output = rng.normal(0, (2 * hidden) ** -0.5, (classes, 2 * hidden)).astype(np.float32)
        self.bias = np.zeros((classes, 1), np.float32)
        self._hold_padding()

    def _hold_padding(self) -> None:
        """At padding the update gate keeps the state as it is."""
        self.inputs[:, :, PAD] = 0
        self.inputs[:, self.h : 2 * self.h, PAD] = 30

    def step(self, x: np.ndarray, state: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: the two directions' bytes (2, B); state: (2, H, B)."""
        h = self.h
        a = np.empty((2, 3 * h, x.shape[1]), np.float32)
        for d in (0, 1):
            np.take(self.inputs[d], x[d], axis=1, out=a[d], mode="clip")
        g = np.matmul(self.recurrent, state)
        gates = a[:, : 2 * h]
        gates += g[:, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        reset, update, new = gates[:, :h], gates[:, h:], a[:, 2 * h :]
        new += reset * g[:, 2 * h :]
        np.tanh(new, out=new)
        after = state - new
        after *= update
        after += new
        if keep is not None:
            keep.append((state, reset, update, new, g[:, 2 * h :]))
        return after

    def states(self, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """windows: (W, B) byte numbers; both directions' states at every position, (W, 2H, B)."""
        w, b = windows.shape
        out = np.empty((w, 2 * self.h, b), np.float32)
        state = np.zeros((2, self.h, b), np.float32)
        for t in range(w):
            state = self.step(np.stack((windows[t], windows[w - 1 - t])), state, keep)
            out[t, : self.h] = state[0]
            out[w - 1 - t, self.h :] = state[1]
        return out

    def labelled(self, states: np.ndarray) -> np.ndarray:
        """Probabilities of every language at every position: (W, C, B)."""
        p = np.matmul(self.output, states)
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p

    def gradients(self, windows: np.ndarray, classes: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean loss over the positions with letters, and its gradients by backpropagation through time."""
        h, (w, b) = self.h, windows.shape
        keep: list = []
        states = self.states(windows, keep)
        p = self.labelled(states)
        mask = LETTERS[windows].astype(np.float32)
        mask /= max(mask.sum(), 1)
        true = p[:, classes, np.arange(b)]
        loss = -float((np.log(true + 1e-9) * mask).sum())
        p[:, classes, np.arange(b)] -= 1
        p *= mask[:, None, :]
        d_output = np.einsum("tcb,thb->ch", p, states, optimize=True)
        d_bias = p.sum(axis=(0, 2))[:, None]
        d_states = np.matmul(self.output.T, p)
        d_a = np.empty((2, w, 3 * h, b), np.float32)
        d_rec = np.zeros_like(self.recurrent)
        back = np.zeros((2, h, b), np.float32)
        for t in range(w - 1, -1, -1):
            state, reset, update, new, g = keep[t]
            dh = back + np.stack((d_states[t, :h], d_states[w - 1 - t, h:]))
            d_new = dh * (1 - update) * (1 - new * new)
            d_update = dh * (state - new) * update * (1 - update)
            d_reset = d_new * g * reset * (1 - reset)
            d_g = np.concatenate((d_reset, d_update, d_new * reset), axis=1)
            d_a[:, t, : 2 * h] = d_g[:, : 2 * h]
            d_a[:, t, 2 * h :] = d_new
            d_rec += np.matmul(d_g, state.transpose(0, 2, 1))
            back = dh * update + np.matmul(self.recurrent.transpose(0, 2, 1), d_g)
        d_in = np.zeros_like(self.inputs)
        for d, x in enumerate((windows, windows[::-1])):
            flat = x.ravel()
            for k in range(3 * h):
                d_in[d, k] = np.bincount(flat, weights=d_a[d, :, k].ravel(), minlength=257)
        d_in[:, :, PAD] = 0
        return loss, [d_in, d_rec, d_output.astype(np.float32), d_bias]


def cut(texts: list[str | None], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in pieces (W, pieces), padded, and each text's number of pieces."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([-(-len(r) // window) for r in raw])
    flat = np.full(int(counts.sum()) * window, PAD, np.int16)
    at = 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        flat[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += n * window
    return flat.reshape(-1, window).T, counts


def train(texts: list[str], labels: list[int], classes: int, seed: int = 0, steps: int = STEPS) -> Network:
    net = Network(classes, seed=seed)
    windows = cut([t.encode("utf-8")[:TRAIN_BYTES].decode("utf-8", "ignore") for t in texts], TRAIN_BYTES)[0]
    labels = np.array(labels)
    weights = [net.inputs, net.recurrent, net.output, net.bias]
    first, second = ([np.zeros_like(x) for x in weights] for _ in range(2))
    rng = np.random.default_rng(seed)
    order = np.empty(0, int)
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(labels))])
        pick, order = order[:BATCH], order[BATCH:]
        _, grads = net.gradients(np.ascontiguousarray(windows[:, pick]), labels[pick])
        norm = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads))))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(weights, grads, first, second, strict=True):
            g = g / norm
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        net._hold_padding()
    return net


def scored(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean probability of every language over each text's letters: (texts, C); 0 where there is none."""
    windows, counts = cut(texts)
    sums = np.zeros((windows.shape[1], len(net.bias) + 1))
    for at in range(0, windows.shape[1], SIDE_BY_SIDE):
        part = np.ascontiguousarray(windows[:, at : at + SIDE_BY_SIDE])
        mask = LETTERS[part]
        states = net.states(part)
        total = np.zeros((len(net.bias), part.shape[1]), np.float32)
        for t in range(0, len(part), 16):
            p = net.labelled(states[t : t + 16])
            p *= mask[t : t + 16, None, :]
            total += p.sum(axis=0)
        sums[at : at + part.shape[1], :-1] = total.T
        sums[at : at + part.shape[1], -1] = mask.sum(axis=0)
    ends = np.cumsum(counts)
    whole = np.vstack([np.zeros((1, sums.shape[1])), np.cumsum(sums, axis=0)])
    by_text = whole[ends] - whole[ends - counts]
    return by_text[:, :-1] / np.maximum(by_text[:, -1:], 1)


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))


def sampled(docs: DataFrame, id_col: str, text_col: str, lang_col: str, seed: int, held: bool = False) -> tuple[list, list[str]]:
    """Rows (i, lang, piece) drawn from those that are not held out (or those that are), and the languages."""
    known = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (held_out(id_col, 3, 1) == held))
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col)).count().collect()}  # one row a language
    names = sorted(sizes)
    if not names:
        return [], []
    wanted = max(TRAIN_WINDOWS, LEAST_PIECES * len(names))
    # Every language gets the same share of the sample, whatever its share of the rows; a
    # few rows more are drawn by their hash, so that little is sent and the cut is exact.
    shares = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, 1.3 * wanted / len(sizes) / n))])
    share = F.element_at(shares, F.col(lang_col))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1 << 40)) + 1) / float(1 << 40)
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.greatest(F.length(text) - TRAIN_BYTES, F.lit(0)).cast("long") + 1) + 1
    sample = (
        known.filter(uniform <= share)
        .filter(text.rlike("\\p{L}"))
        .select((uniform / share).alias("turn"), F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), text.substr(start.cast("int"), F.lit(TRAIN_BYTES)).alias("piece"))
        .orderBy("turn", "i", "lang", "piece")
        .limit(wanted)
        .collect()
    )
    return sample, names


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> tuple[Network | None, list[str]]:
    """The network and its languages, from the rows that are not held out."""
    sample, names = sampled(docs, id_col, text_col, lang_col, seed)
    if not sample:
        return None, []
    return train([r.piece for r in sample], [names.index(r.lang) for r in sample], len(names), seed), names


def junk_pieces(texts: list[str], n: int, seed: int = 0) -> list[str]:
    """``n`` pieces with letters and without a language: letters drawn at random from those of ``texts`` or of ASCII, codes, repeated motifs."""
    rng = random.Random(seed)
    own = sorted(filter(str.isalpha, set("".join(texts)))) or list(string.ascii_lowercase)
    kinds = [(own, 1, 12), (string.ascii_lowercase, 1, 12), (string.ascii_letters + string.digits + "+/", 8, 76), ("0123456789abcdef", 4, 40)]
    out = []
    for k in range(n):
        letters, least, most = kinds[k % len(kinds)] if k % 5 else (rng.choices(own, k=rng.randint(1, 4)), 2, 30)
        piece, motif = [], "".join(rng.choices(letters, k=rng.randint(2, 5)))
        while sum(map(len, piece)) < TRAIN_BYTES:
            size = rng.randint(least, most)
            piece.append((motif * size)[:size] if k % 5 == 0 else "".join(rng.choices(letters, k=size)))
        out.append(" ".join(piece)[: rng.choice((12, 24, 48, TRAIN_BYTES))])
    return out


def predicted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: tuple[Network | None, list[str]] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    net, names = model or fit(docs, id_col, text_col, lang_col)

    def each(ids, outs, texts):
        has = list(map(has_letter, texts))
        if net is None:
            best, top = [None] * len(ids), [0.0] * len(ids)
        else:
            p = scored(net, texts)
            best, top = [names[k] for k in p.argmax(axis=1)], p.max(axis=1).clip(0, 1).tolist()
        yield {
            "doc_id": ids,
            "held_out": outs,
            "lang_pred": [b if h and b else "und" for b, h in zip(best, has, strict=True)],
            "score": [s if h else 0.0 for s, h in zip(top, has, strict=True)],
        }

    return map_arrow(docs.select(id_col, held_out(id_col, 3, 1).alias("held_out"), text_col), each, "doc_id long, held_out boolean, lang_pred string, score double")


#: The share of held-out labelled texts that may go, and the least bound.
MAY_GO, LEAST_BOUND = 0.002, 0.5


def fit_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 0) -> tuple[Network | None, float]:
    """A network whose last class is "no language", and the bound of that class's probability above which a text goes."""
    sample, names = sampled(docs, id_col, text_col, lang_col, seed)
    apart = sampled(docs, id_col, text_col, lang_col, seed, held=True)[0] if sample else []
    if not apart:
        return None, 1.0
    texts = [r.piece for r in sample]
    # As many as an average language has.
    junk = junk_pieces(texts, -(-len(texts) // len(names)), seed)
    net = train(texts + junk, [names.index(r.lang) for r in sample] + [len(names)] * len(junk), len(names) + 1, seed)
    none = scored(net, [r.piece for r in apart])[:, -1]
    room = 1 - max(LEAST_BOUND, float(np.quantile(none, 1 - MAY_GO, method="higher")))
    # Fewer texts than tell a share of MAY_GO say less about those not seen.
    return net, 1 - room * min(1.0, MAY_GO * len(apart))


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with all their columns, in which a language is recognised; in one pass, without a shuffle."""
    net, bound = fit_filter(docs, id_col, text_col, lang_col)
    kinds = docs.schema
    text_at = docs.columns.index(text_col)

    def kept(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(text_at).to_pylist()
                has = np.array(list(map(has_letter, texts)))
                good = has & (scored(net, texts)[:, -1] <= bound) if net else has
                yield part.filter(pa.array(good))

    # Columns go in by place: a name with a dot would be read as a field.
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))]).mapInArrow(kept, kinds)
