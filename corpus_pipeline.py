"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of ``documents``. Between stages the rows are written as Parquet, here to
the shared folder, and read again.

Rules, by case: null and empty texts hold no language and go in the first stage; texts of
any length are read whole; repeated rows are equal texts, of which one stays; of equal
texts the largest id stays, of near copies the smallest, and rows that share an id stay
or go together there; a null source is a source of its own; extra columns, whatever
their names, are kept up to the last stage; an empty table gives an empty result. Near
copies are those of the operator's contract: four words a shingle, four bits at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bidloom.llm import bpe, exact_dedup, langid, mixing, simhash
from bidloom.llm.common import Saved, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose letters form none of the labelled languages, go."""
    return langid.accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_dedup.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies, the row with the smallest id stays."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of rare sources are repeated up to their source's weight, and all are put in blocks that hold every source by its weight; none goes."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids and their text again: doc_id, ids, decoded."""
    return bpe.encoded(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]

#: SQL can't express the network, fingerprints and tokens; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = Saved(docs).df
    return docs
