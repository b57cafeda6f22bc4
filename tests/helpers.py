"""Small frames for hand-worked cases."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY = "2024-01-02"


def at(text: str) -> datetime:
    """UTC time; a bare time of day is on ``DAY``."""
    return datetime.fromisoformat(text if "-" in text else f"{DAY} {text}").replace(tzinfo=timezone.utc)


def plus(start: str, minutes: float) -> datetime:
    return at(start) + timedelta(minutes=minutes)


def bars(spark, rows) -> DataFrame:
    """(ticker, timestamp, close) with the other columns filled in."""
    frame = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double")
    price = F.col("close")
    return frame.select(
        "ticker",
        "timestamp",
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        "close",
        F.lit(1.0).alias("volume"),
    )


def scored(spark, rows) -> DataFrame:
    """(ticker, timestamp, score)"""
    frame = spark.createDataFrame(rows, "ticker string, timestamp timestamp, sentiment_score double")
    return frame.withColumns(
        {
            "id": F.concat_ws("-", "ticker", F.unix_micros("timestamp")),
            "positive": (1 + F.col("sentiment_score")) / 2,
            "negative": (1 - F.col("sentiment_score")) / 2,
        }
    )


def buckets(spark, rows) -> DataFrame:
    return spark.createDataFrame(
        rows,
        "ticker string, timestamp timestamp, avg_sentiment double, post_count long, "
        "avg_positive double, avg_negative double",
    )


def ordered(df: DataFrame, *columns: str) -> list[tuple]:
    """The columns as tuples, by ticker and time; one column as plain values."""
    rows = df.orderBy("ticker", "timestamp").select(*columns).collect()
    return [row[0] for row in rows] if len(columns) == 1 else [tuple(row) for row in rows]
