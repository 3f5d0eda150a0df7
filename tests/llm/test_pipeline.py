import pytest

from pyspark.sql import functions as F

from bidloom.llm import exact_dedup, langid, mixing, simhash
from bidloom.llm.common import Saved

from .helpers import odd_docs, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, tmp_path):
    rows = [(i, prose(i, 60, "abcdefg" if i % 2 else "hijklmn"), ("aa", "bb")[i % 2], f"s{i % 3}", 0) for i in range(120)]
    rows += [(200, rows[3][1], "aa", "s0", 0), (201, rows[5][1] + " tail", "aa", "s1", 0), (202, "12 34", "aa", "s2", 0), (203, None, None, None, 0)]
    rows += [(204, prose(900, 500, "abcdefg"), "bb", "s0", 0), (205, prose(900, 499, "abcdefg") + " last", "bb", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now, plain = docs, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    for f in (langid.accepted, exact_dedup.deduplicated, simhash.one_of_each, mixing.mixed):
        plain = f(plain)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in plain.collect())
    ids = {r.doc_id for r in got}
    assert not ids & {3, 202, 203, 205} and {200, 204} <= ids and set(range(6, 120)) <= ids
    assert all(r.ids and r.decoded for r in got)


def test_odd_and_empty_tables(spark):
    """Nulls, repeats, long texts and clashing names in every stage; then no rows at all."""
    odd = odd_docs(spark).withColumn("_key", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("fp", F.lit(3))
    for docs in (odd, odd.limit(0)):
        rows = docs
        for name, stage in corpus_pipeline.STAGES:
            rows = Saved(stage(spark, rows, "")).df
            if name != "bpe":
                assert rows.columns == docs.columns, name
        ids = {r.doc_id for r in rows.collect()}
        assert ids == ({None, 4, 5, 7, 9, 10, 11} if docs is odd else set()), ids
