"""Posts into sentiment buckets, and the small post views."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.functions.cells import placed
from pitflow.functions.durations import bucket_us, interval_sql
from pitflow.functions.text import (
    feed_text,
    feed_time,
    html_escape,
    not_nan,
    sentiment_label,
    ticker_symbol,
)
from pitflow.functions.utc import utc_session
from pitflow.operators.keyed import latest_per_key
from pitflow.schemas import BUCKET_WINDOW, FEED_POSTS, FEED_TEXT_LENGTH, RECENT_POSTS


def bucket_aggregates() -> list[Column]:
    score = not_nan(F.col("sentiment_score"))
    return [
        F.avg(score).alias("avg_sentiment"),
        F.count(score).alias("post_count"),
        F.avg(not_nan(F.col("positive"))).alias("avg_positive"),
        F.avg(not_nan(F.col("negative"))).alias("avg_negative"),
    ]


def tumbling(window: str) -> Column:
    return F.window("timestamp", interval_sql(bucket_us(window)))


def stamped_at_end(grouped: DataFrame) -> DataFrame:
    return grouped.select(
        "ticker",
        F.col("window.end").alias("timestamp"),
        "avg_sentiment",
        "post_count",
        "avg_positive",
        "avg_negative",
    ).filter("post_count > 0")


def aggregate_sentiment(scored: DataFrame, window: str = BUCKET_WINDOW) -> DataFrame:
    """Mean scores and scored-post count per ticker and tumbling window.

    The stamp is the window's end, the first moment its content is known.
    Averages combine before the shuffle, so a hot ticker or a hot window
    arrives as one partial row per task. Posts without ticker or time are in no
    bucket.
    """
    return stamped_at_end(
        placed(scored).groupBy("ticker", tumbling(window).alias("window")).agg(*bucket_aggregates())
    )


def label_posts(scored: DataFrame) -> DataFrame:
    return scored.withColumn("label", sentiment_label(F.col("sentiment_score")))


def normalize_tickers(df: DataFrame, universe, column: str = "ticker") -> DataFrame:
    """Upper-cases, drops leading ``$`` and keeps known tickers. ``universe``
    is a list of names or a DataFrame with a ``ticker`` column."""
    df = df.withColumn(column, ticker_symbol(F.col(column)))
    if isinstance(universe, DataFrame):
        known = universe.select(F.col("ticker").alias(column)).distinct()
        return df.join(known, column, "left_semi")
    return df.filter(F.col(column).isin(list(universe)))


def tickers(df: DataFrame) -> DataFrame:
    return df.select("ticker").distinct().orderBy("ticker")


def dedupe_posts(posts: DataFrame) -> DataFrame:
    """One row per id: the newest, ties settled by content."""
    ties = [F.col(c).desc() for c in ("ticker", "source", "text") if c in posts.columns]
    return latest_per_key(posts, ["id"], [F.col("timestamp").desc(), *ties])


def recent_posts(scored: DataFrame, n: int = RECENT_POSTS, ticker: str | None = None) -> DataFrame:
    """The newest ``n`` posts of one ticker, or of each ticker."""
    newest = [F.col("timestamp").desc(), F.col("id").asc()]
    if ticker is not None:
        return scored.filter(F.col("ticker") == ticker).orderBy(*newest).limit(n)
    order = Window.partitionBy("ticker").orderBy(*newest)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def post_feed(
    posts: DataFrame,
    n: int = FEED_POSTS,
    ticker: str | None = None,
    length: int = FEED_TEXT_LENGTH,
    score: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Recent posts as display fields; text and source are HTML-escaped. With
    ``score``, posts come unscored and only those shown are scored."""
    utc_session(posts.sparkSession)
    shown = recent_posts(posts, n, ticker)
    if score is not None:
        shown = score(shown)
    return shown.select(
        "ticker",
        "id",
        sentiment_label(F.col("sentiment_score")).alias("label"),
        feed_time(F.col("timestamp")).alias("time"),
        html_escape(F.col("source")).alias("source"),
        feed_text(F.col("text"), length).alias("text"),
    )
