"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words and white space as every contract of this package means them.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows per Arrow batch. Texts can be long, and a batch is held in memory whole.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, small Arrow batches set for what follows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``. Only a local session that names none gets one of
    its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder: computed once, safe
    from lost executors, and with no lineage to run again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """The rows of ``sample`` (doc_id and others), a bounded number with one row
    per id, with the text of their document. Of rows that share an id the text with
    the smallest hash counts, so as many rows come back at most."""
    rows = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id")), "doc_id")
    texts = rows.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.xxhash64("text"))["text"].alias("text"))
    return texts.join(F.broadcast(sample), "doc_id")
