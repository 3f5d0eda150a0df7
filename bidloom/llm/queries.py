"""The registered queries of the operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, filter_audit, langid, licences, lm_score, mixing, pii, simhash, tiered_search, topk, toxicity, url_filter
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs.withColumn("path", licences.path_of_document()), "path", "text", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.linked(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.of_table(table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learned(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(table(spark, sf_dir, "documents"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judged(pages, url_filter.Trie(url_filter.RULES), "url").drop("url")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = tiered_search.build(table(spark, sf_dir, "documents"))
    return tiered_search.search(index, table(spark, sf_dir, "benchmark")).drop("tier")


QUERIES = {f.__name__: f for f in (op1_pii, op2_licences, op3_simhash, op4_topk, op5_toxicity, op6_bpe, op7_lm_score, op8_mixing, op9_langid, op10_exact_dedup, op11_url_filter, op12_filter_audit, op13_tiered_search)}

ORACLES = {
    "op2_licences": licences.oracle(),
    "op4_topk": topk.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_url_filter": url_filter.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_tiered_search": tiered_search.ORACLE,
}
