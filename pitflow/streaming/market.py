"""Buckets and bars kept by streams as parts that add up.

A batch of posts or ticks becomes one row per ticker and window, with what
merges: sums and counts, the first and the last price. Rows of many batches for
one window are merged when they are read, so late posts and ticks count however
late they are, open windows are there as far as they are known, and no state is
held. Folding a live table merges its rows for good.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitflow.functions.cells import placed
from pitflow.functions.durations import bucket_us, interval_sql
from pitflow.functions.text import not_nan
from pitflow.operators.sentiment import tumbling
from pitflow.schemas import BUCKET_WINDOW, TRIGGER
from pitflow.sources.bars import tick_order
from pitflow.sources.live import FOLD_EVERY, LiveTable
from pitflow.sources.tables import DEFAULT_FEED

MEASURES = {"sentiment_score": "avg_sentiment", "positive": "avg_positive", "negative": "avg_negative"}
KEY = ("ticker", "timestamp")

PART_KEY = [T.StructField("ticker", T.StringType()), T.StructField("timestamp", T.TimestampType())]
BUCKET_PART = T.StructType(
    PART_KEY
    + [T.StructField(f"{m}_{kind}", t) for m in MEASURES for kind, t in (("sum", T.DoubleType()), ("count", T.LongType()))]
)
_TICK = T.StructType([T.StructField("at", T.DecimalType(38, 0)), T.StructField("price", T.DoubleType())])
BAR_PART = T.StructType(
    PART_KEY
    + [
        T.StructField("first", _TICK),
        T.StructField("last", _TICK),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)


def _no_batch(rows: DataFrame) -> DataFrame:
    """Merged rows are of no batch any more."""
    return rows.withColumns({"feed": F.lit(None).cast("string"), "batch_id": F.lit(None).cast("long")})


# --- buckets -----------------------------------------------------------------


def bucket_parts(scored: DataFrame, window: str = BUCKET_WINDOW) -> DataFrame:
    """One row per ticker and window, stamped at the window's end."""

    def sums(measure: str) -> list[Column]:
        value = not_nan(F.col(measure))
        return [F.sum(value).alias(f"{measure}_sum"), F.count(value).alias(f"{measure}_count")]

    grouped = placed(scored).groupBy("ticker", tumbling(window).alias("window"))
    parts = grouped.agg(*(c for m in MEASURES for c in sums(m)))
    return parts.select("ticker", F.col("window.end").alias("timestamp"), *BUCKET_PART.names[2:])


def merged_buckets(parts: DataFrame) -> DataFrame:
    names = BUCKET_PART.names[2:]
    return _no_batch(parts.groupBy(*KEY).agg(*(F.sum(n).alias(n) for n in names)))


def buckets_of(parts: DataFrame) -> DataFrame:
    """The batch aggregate, from merged parts."""

    def mean(measure: str, name: str) -> Column:
        return F.try_divide(F.col(f"{measure}_sum"), F.col(f"{measure}_count")).alias(name)

    means = {name: mean(m, name) for m, name in MEASURES.items()}
    return parts.filter("sentiment_score_count > 0").select(
        *KEY,
        means["avg_sentiment"],
        F.col("sentiment_score_count").alias("post_count"),
        means["avg_positive"],
        means["avg_negative"],
    )


def bucket_part_table(root: str) -> LiveTable:
    return LiveTable(root, BUCKET_PART, merged_buckets)


# --- bars --------------------------------------------------------------------


def bar_parts(ticks: DataFrame, interval: str) -> DataFrame:
    """One row per ticker and window, stamped at the window's start."""
    tick = F.struct(tick_order().alias("at"), "price")
    window = F.window("timestamp", interval_sql(bucket_us(interval))).alias("window")
    parts = placed(ticks).groupBy("ticker", window).agg(
        F.min_by(tick, tick_order()).alias("first"),
        F.max_by(tick, tick_order()).alias("last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("size").alias("volume"),
    )
    return parts.select("ticker", F.col("window.start").alias("timestamp"), *BAR_PART.names[2:])


def merged_bars(parts: DataFrame) -> DataFrame:
    return _no_batch(
        parts.groupBy(*KEY).agg(
            F.min_by("first", "first.at").alias("first"),
            F.max_by("last", "last.at").alias("last"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.sum("volume").alias("volume"),
        )
    )


def bars_of(parts: DataFrame) -> DataFrame:
    """OHLCV bars, from merged parts."""
    prices = [F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close")]
    return parts.select(*KEY, *prices, "volume")


def bar_part_table(root: str) -> LiveTable:
    return LiveTable(root, BAR_PART, merged_bars)


# --- jobs --------------------------------------------------------------------


def _start(
    rows: DataFrame,
    parts: Callable[[DataFrame], DataFrame],
    table: LiveTable,
    checkpoint: str,
    trigger: dict | None,
    feed: str,
    fold_every: int,
) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(
            lambda batch, batch_id: table.take(parts(batch), batch_id, feed, fold_every)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )


def start_live_buckets(
    scored: DataFrame,
    table: LiveTable,
    checkpoint: str,
    window: str = BUCKET_WINDOW,
    trigger: dict | None = None,
    feed: str = DEFAULT_FEED,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Keeps ``bucket_part_table``; ``buckets_of`` its ``current`` is the batch
    aggregate of all posts so far, late ones too."""
    return _start(scored, lambda b: bucket_parts(b, window), table, checkpoint, trigger, feed, fold_every)


def start_live_bars(
    ticks: DataFrame,
    table: LiveTable,
    interval: str,
    checkpoint: str,
    trigger: dict | None = None,
    feed: str = DEFAULT_FEED,
    fold_every: int = FOLD_EVERY,
) -> StreamingQuery:
    """Keeps ``bar_part_table``; ``bars_of`` its ``current`` is ``resample`` of all
    ticks so far, late ones too."""
    return _start(ticks, lambda b: bar_parts(b, interval), table, checkpoint, trigger, feed, fold_every)
