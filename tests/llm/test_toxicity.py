import math
import random
import zlib

from bidloom.llm import toxicity

from .helpers import odd_docs, prose


def test_places_are_the_text_s_n_grams():
    assert [len(p) for p in toxicity.places("ab, CD")] == [5, 4, 3, 2]  # " ab cd "
    a, b = (set(map(int, p)) for p in (toxicity.places("Stupid!")[1], toxicity.places("so stupid it")[1]))
    assert len(a & b) >= 4


def test_held_out_rows_are_found(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(i, rng.randint(20, 200), "aeinorst").split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["zumpf", "krawk", "blixen"]) + rng.choice(["s", "ing", ""]))
        docs.append((i, " ".join(words), "x"))
        labels.append((i, 1 - toxic, int(toxic)))
    docs += [(900, None, "x"), (901, "", "x"), (None, "text", "x"), (5, docs[5][1], "x"), (902, "zumpf " + prose(1, 30_000, "aeinorst"), "x")]
    labels += [(5, 1, None), (None, 1, 1), (7, 1, 0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, label string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, labels)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 900]
    assert {r.doc_id for r in held} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) / len(held) > 0.97


def test_ratios_and_scores_by_plain_counts(spark):
    """Counts, ratios and the features kept by dictionaries; scores by sums over a text's n-grams."""
    texts = [(int(i % 3 == 0), prose(i, 12, "abcde") + (" zumpf zumpfing" if i % 3 == 0 else "")) for i in range(90)]
    grams = [(label, {int(x) for p in toxicity.places(t) for x in p}) for label, t in texts]
    rows = spark.createDataFrame([(label, sorted(g)) for label, g in grams], "label int, at array<int>")
    got = dict(map(tuple, toxicity.ratios(rows, {0: 60, 1: 30}).collect()))
    want = {}
    for place in set().union(*(g for _, g in grams)):
        c1, c0 = (sum(place in g for label, g in grams if label == k) for k in (1, 0))
        ratio = math.log((c1 + 1) / 32) - math.log((c0 + 1) / 62)
        if c0 + c1 >= toxicity.LEAST_TEXTS and abs(ratio) >= toxicity.ERRORS * math.sqrt(1 / (c0 + 1) + 1 / (c1 + 1)):
            want[place] = ratio
    assert 0 < len(want) <= toxicity.FEATURES and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    model = toxicity.fit(rows)
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)] + [(99, "")], "doc_id long, text string")
    for r in toxicity.scored(docs, model).collect():
        places = grams[r.doc_id][1] if r.doc_id < 90 else set()
        z = model.base + sum(float(model.weights[p]) for p in places)
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(200)], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, int((i % 3 == 0) != (flip and zlib.crc32(str(i).encode()) % 4 == 2))) for i in range(200)], "doc_id long, toxic int")
    a, b = (toxicity.scored(docs, toxicity.learned(docs, label(f))).collect() for f in (False, True))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_nothing_to_learn_from(spark):
    docs = odd_docs(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.scored(docs, toxicity.learned(docs, none)).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.learned(docs.limit(0), none)).collect() == []
