"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor
kept, and returns a DataFrame that ``run`` writes as Parquet and reads again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pitflow.llm import stages
from pitflow.llm.common import shared_root, table

STAGES = [
    ("language_id", stages.language_id),
    ("toxicity", stages.toxic_removed),
    ("simhash_near_dedup", stages.simhash_near_dedup),
    ("mixing", stages.mixing_sources),
    ("sentencepiece", stages.sentencepiece),
]

#: Models and sampled segmentations are beyond SQL; tests/llm hold the stages
#: against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_root(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{folder}/{number}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
