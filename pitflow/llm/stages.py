"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) -> rows.

All but the last return the columns of ``docs``, whatever their names. Rows with
nulls in any column, without id, with repeated ids or repeated as they are go
through every stage as rows like others; what each stage makes of them is said
below. An empty table gives an empty one everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitflow.llm import language, mixing, pieces, simhash, toxicity
from pitflow.llm.common import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are ``und`` go: null text, no letter, or no language learned.
    Shares decide nothing here, so a text in a language that was not learned stays."""
    return language.identified(docs)


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Null and empty texts hold no evidence and
    stay, if the labels show clean documents at all."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: the smallest id, rows without id
    last. Null texts, empty ones and such of white space are one group."""
    return simhash.dedupe(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: rows taken twice are there
    twice, rows not taken are gone. Rows without words have size 0 and are taken by
    their hash; a null source is a source of its own."""
    return mixing.mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every row, with a proof that they decode to its text; null
    texts have null pieces."""
    return pieces.round_trip(docs)
