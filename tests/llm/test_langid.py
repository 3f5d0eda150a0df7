import random
import string
import zlib

import numpy as np

from bidloom.llm import langid

from .helpers import odd_docs, odd_rows, prose


def test_gradients_equal_differences():
    net = langid.Network(3, hidden=4, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (7, 5)), rng.integers(0, 3, 5)
    x[5:, 2] = langid.PAD
    for a in ("inputs", "recurrent", "output", "bias"):
        setattr(net, a, getattr(net, a).astype(np.float64))
    _, grads = net.gradients(x, y)
    for name, g in zip(("inputs", "recurrent", "output", "bias"), grads):
        w = getattr(net, name)
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(30)] + ([(0, 3, int(x[0, 0])), (1, 9, int(x[1, 1]))] if name == "inputs" else []):
            if name == "inputs" and at[2] == langid.PAD:
                continue
            keep, e, losses = w[at], 1e-2, []
            for d in (e, -e):
                w[at] = keep + d
                losses.append(net.gradients(x, y)[0])
            w[at] = keep
            assert abs((losses[0] - losses[1]) / (2 * e) - g[at]) < 2e-3


def plain_scores(net, text):
    """A text's probabilities by a plain loop over its bytes, one piece after the other."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    raw, h, sums, letters = text.encode(), net.h, 0, 0
    for at in range(0, len(raw), langid.WINDOW):
        piece = raw[at : at + langid.WINDOW]
        states = [[], []]
        for d, part in enumerate((piece, piece[::-1])):
            state = np.zeros(h)
            for byte in part:
                a, g = net.inputs[d, :, byte].astype(float), net.recurrent[d].astype(float) @ state
                reset, update = sig(a[:h] + g[:h]), sig(a[h : 2 * h] + g[h : 2 * h])
                new = np.tanh(a[2 * h :] + reset * g[2 * h :])
                state = update * state + (1 - update) * new
                states[d].append(state)
        for byte, left, right in zip(piece, states[0], states[1][::-1]):
            if byte >= 128 or chr(byte).isalpha():
                z = net.output.astype(float) @ np.concatenate((left, right)) + net.bias[:, 0]
                p = np.exp(z - z.max())
                sums, letters = sums + p / p.sum(), letters + 1
    return sums / max(letters, 1)


def test_scores_equal_a_plain_forward_pass():
    net = langid.train([prose(i, 30, "abc" if i % 2 else "xyzé") for i in range(64)], [i % 2 for i in range(64)], 2, steps=8)
    texts = ["a", "été 12", prose(3, 200, "abcxyzé"), "x" * 129, prose(4, 37, "aé")]
    got = langid.scored(net, texts)
    assert all(np.allclose(g, plain_scores(net, t), atol=1e-4) for g, t in zip(got, texts))


def test_numbers_that_look_like_letters_are_none(spark):
    texts = ["½ ² Ⅷ ①", "١٢٣ 12", "_", "ª", "漢", "a1"]
    assert [langid.has_letter(t) for t in texts] == [False, False, False, True, True, True]
    rows, _ = corpus(spark)
    docs = spark.createDataFrame(rows[:90] + [(900, texts[0], None, "s"), (901, "漢", None, "s")], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r.lang_pred for r in langid.predicted(docs).collect()}
    assert got[900] == "und" and got[901] in ("aa", "bb", "cc")
    assert {900} == {r[0] for r in rows[:90] + [(900,), (901,)]} - {r.doc_id for r in langid.accepted(docs).collect()} - {901}


def test_any_number_of_languages(spark):
    """More languages than an earlier bound of 400: all of them are learned."""
    rows = [(i, prose(i, 8), f"l{i % 450:03d}") for i in range(2000)]
    sample, names = langid.sampled(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", 0)
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(names) > 400 and set(names) == learned == {r.lang for r in sample}


def corpus(spark):
    letters = {"aa": "abcdefg", "bb": "hijklmn", "cc": "äöüßxyz"}
    rows = [(i, prose(i, 5 + i % 60, letters[k]), k, "s") for i in range(600) for k in [("aa", "bb", "cc")[i % 3]]]
    rows += [(600, prose(1, 4000, "hijklmn"), "bb", "s"), (601, "!!! 123", "aa", "s"), (602, None, "aa", "s"), (None, "abc def", None, "s")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_held_out_accuracy_and_rules(spark):
    rows, docs = corpus(spark)
    got = langid.predicted(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(by_id[i].held_out == (i in held) for i in range(600))
    assert sum(by_id[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97
    assert by_id[600].lang_pred == "bb" and by_id[601].lang_pred == by_id[602].lang_pred == "und"


def test_pieces_make_no_difference_to_what_is_counted(spark):
    """Every position of a long text is labelled once: a text of equal pieces scores as one piece."""
    net = langid.train([prose(i, 30, "abc" if i % 2 else "xyz") for i in range(64)], [i % 2 for i in range(64)], 2, steps=5)
    piece = prose(1, 100, "abcxyz")[: langid.WINDOW - 1] + " "
    assert np.allclose(langid.scored(net, [piece]), langid.scored(net, [piece * 40]), atol=1e-4)


def test_accepted_keeps_columns_and_good_rows(spark):
    rows, docs = corpus(spark)
    got = langid.accepted(docs)
    assert got.schema == docs.schema
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows} - {601, 602}
    odd = langid.accepted(odd_docs(spark))
    assert odd.columns == odd_docs(spark).columns and {4, 5, 6, 9, 11} <= {r.doc_id for r in odd.collect()}
    assert langid.predicted(odd_docs(spark).limit(0)).collect() == []
    assert len(langid.predicted(odd_docs(spark)).collect()) == len(odd_rows())


def test_lettered_junk_goes_for_any_number_of_languages(spark):
    rng = random.Random(7)
    junk = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=60 + 9 * i)) for i in range(12)] + ["qwrt zxcv " * 9, "WKQ PZV " * 12]
    rows, _ = corpus(spark)
    for names in (("aa",), ("aa", "bb"), ("aa", "bb", "cc")):
        clean = [r for r in rows[:600] if r[2] in names]
        short = [(800 + i, r[1].split(" ")[0], r[2], "s") for i, r in enumerate(clean[:20])]
        docs = spark.createDataFrame(clean + short + [(700 + i, t, None, "s") for i, t in enumerate(junk)], "doc_id long, text string, lang string, score string")
        got = {r.doc_id for r in langid.accepted(docs).collect()}
        assert len(got & {r[0] for r in clean + short}) >= 0.99 * len(clean + short)
        assert len(got & set(range(700, 700 + len(junk)))) <= 1
