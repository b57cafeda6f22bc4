"""The operators of this package as queries over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitflow.llm import (
    audit,
    extraction,
    language,
    merges,
    mixing,
    parsing,
    pieces,
    quality,
    sharding,
    simhash,
    toxicity,
    vectors,
    whitening,
)
from pitflow.llm.common import table


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.score_documents(docs, labels)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score_documents(docs, labels)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_pages(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merges.round_trip(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_quality": op2_quality,
    "op3_toxicity": op3_toxicity,
    "op4_sharding": op4_sharding,
    "op5_html": op5_html,
    "op6_language": op6_language,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_fingerprints": op9_fingerprints,
    "op10_simhash": op10_simhash,
    "op11_audit": op11_audit,
    "op12_merges": op12_merges,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op7_mixing": mixing.ORACLE.replace("{docs}", "documents"),
    "op11_audit": audit.ORACLE.replace("{docs}", "documents").replace("{labels}", "labels"),
}
