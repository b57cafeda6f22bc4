"""The driver's tables as posts, bars, subscriptions and texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitflow.schemas import RAW_FIELDS, ROLLING_WINDOWS, SOURCES
from pitflow.sources.posts import serialize_posts


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


# The two word lists the lexicon scorer is tested with.
POSITIVE_WORDS = ("the", "of", "is")
NEGATIVE_WORDS = ("and", "to", "that")


def posts(events: DataFrame, ticker: str = "event_type") -> DataFrame:
    """Scored posts. The score is a fixed function of the event's ``k``; its
    offset keeps every rolling mean away from both signal thresholds, and every
    mean away from a tie when it is rounded for comparison."""
    k = F.get_json_object("props", "$.k").cast("double")
    score = (k - F.lit(49.8317283)) / F.lit(50.0)
    source = F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (F.col("user_id") % 3 + 1).cast("int"))
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        F.col(ticker).cast("string").alias("ticker"),
        F.col("ts").alias("timestamp"),
        source.alias("source"),
        F.col("props").alias("text"),
        ((1 + score) / 2 * 0.8).alias("positive"),
        F.lit(0.2).alias("neutral"),
        ((1 - score) / 2 * 0.8).alias("negative"),
        score.alias("sentiment_score"),
    )


def ticks(events: DataFrame, ticker: str = "event_type") -> DataFrame:
    return events.select(
        F.col("event_id").alias("tick_id"),
        F.col(ticker).cast("string").alias("ticker"),
        F.col("ts").alias("timestamp"),
        (F.col("value") + F.lit(100.0)).alias("price"),
        F.lit(1.0).alias("size"),
    )


def wire_posts(posts: DataFrame) -> DataFrame:
    """Posts as bus records. Every fiftieth value lost its last characters on
    the way, so the reject path has something to reject; no post is left out."""
    sent = serialize_posts(posts.select(*RAW_FIELDS)).withColumn("json", F.col("value").cast("string"))
    broken = F.get_json_object("json", "$.id").cast("long") % 50 == 0
    cut = F.expr("substring(json, 1, length(json) - 5)")
    return sent.select("key", F.when(broken, cut).otherwise(F.col("json")).cast("binary").alias("value"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def document_posts(documents: DataFrame) -> DataFrame:
    """Documents as raw posts, one per minute, the language as ticker."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("lang").alias("ticker"),
        F.timestamp_micros(F.unix_micros(start) + F.col("doc_id") * F.lit(60_000_000)).alias("timestamp"),
        "source",
        "text",
    )


def subscriptions(events: DataFrame) -> DataFrame:
    """One chat per user from the user's first event on, following its type, at
    one of the four windows. The columns are those of ``SUBSCRIPTION``."""
    windows = F.array(*[F.lit(w) for w in ROLLING_WINDOWS])
    return (
        events.groupBy(F.col("user_id").alias("chat_id"))
        .agg(F.min_by("event_type", "event_id").alias("ticker"), F.min("ts").alias("subscribed_at"))
        .select(
            "chat_id",
            "ticker",
            F.element_at(windows, (F.floor(F.col("chat_id") / 2) % 4 + 1).cast("int")).alias("window"),
            (F.col("chat_id") % 2 == 0).alias("subscribed"),
            "subscribed_at",
        )
    )
