"""Alerts for every crossing in a stream of bars with rolling sentiment."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitflow.functions.durations import duration_us, interval_sql
from pitflow.operators.alerts import CHATS_TOGETHER, crossings, for_chats, not_yet_sent
from pitflow.operators.keyed import latest_per_key
from pitflow.operators.signals import generate_signals, roll_column
from pitflow.schemas import ALERT, ALERT_TRIGGER, ENTRY_THRESHOLD, EXIT_THRESHOLD, SIGNAL_WINDOW
from pitflow.sources.tables import (
    DEFAULT_FEED,
    batch_path,
    read_batches,
    read_path,
    write_batch,
)

#: How far behind a ticker's newest bar a new one may be.
LATENESS = "1d"


@dataclass(frozen=True)
class AlertTables:
    log: str
    last_bars: str


def _bar_schema(roll: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("ticker", T.StringType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField(roll, T.DoubleType()),
        ]
    )


def _newest_state(spark: SparkSession, root: str, feed: str, batch_id: int, roll: str) -> DataFrame:
    """The bars kept by the batch before this one, or, in a new feed, by the
    last batch of another one. The last two snapshots of a feed have rows."""
    schema = T.StructType(
        _bar_schema(roll).fields + [T.StructField("feed", T.StringType()), T.StructField("batch_id", T.LongType())]
    )
    kept = read_path(spark, root, schema, missing_ok=True)
    usable = (F.col("feed") != feed) | (F.col("batch_id") < batch_id)
    newest = (
        kept.filter(usable)
        .select((F.col("feed") == feed).alias("own"), "batch_id", "feed")
        .agg(F.max(F.struct("own", "batch_id", "feed")).alias("at"))
        .first()["at"]
    )
    if newest is None:
        return spark.createDataFrame([], _bar_schema(roll))
    at = (F.col("feed") == newest["feed"]) & (F.col("batch_id") == newest["batch_id"])
    return kept.filter(at).drop("feed", "batch_id")


def _to_keep(rows: DataFrame, lateness: str, roll: str) -> DataFrame:
    """Each ticker's bars within ``lateness`` of its newest, and the one before."""
    newest = rows.groupBy("ticker").agg(F.max("timestamp").alias("_newest"))
    bound = F.col("_newest") - F.expr(f"interval {interval_sql(duration_us(lateness))}")
    aged = rows.join(newest, "ticker").withColumn("_old", F.col("timestamp") < bound)
    before = (
        aged.filter("_old").groupBy("ticker").agg(F.max_by(F.struct("timestamp", roll), "timestamp").alias("b"))
    )
    return aged.filter("not _old").select("ticker", "timestamp", roll).unionByName(
        before.select("ticker", "b.*")
    )


def alert_batch(
    bars: DataFrame,
    batch_id: int,
    subscriptions: Callable[[], DataFrame],
    tables: AlertTables,
    label: str = SIGNAL_WINDOW,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    feed: str = DEFAULT_FEED,
    lateness: str = LATENESS,
    together: int = CHATS_TOGETHER,
) -> None:
    """Checks all bars from the first new one of a ticker on, and logs alerts.

    The bars of the last ``lateness`` per ticker are kept as a snapshot per
    batch. A bar sent again replaces its older version, and a late bar takes its
    place among the others, so crossings are those of the series as it is known
    now; what was sent stays sent. Bars older than the snapshot are left to the
    batch crossings over the bar table. Chats are read anew in each batch.

    Both outputs are replaced when a batch runs again, and its own log entries
    do not count as sent. A new feed goes on from the last one's snapshot.
    """
    spark = bars.sparkSession
    roll = roll_column(label)
    known = _newest_state(spark, tables.last_bars, feed, batch_id, roll)
    known_from = known.groupBy("ticker").agg(F.min("timestamp").alias("_from"))
    fresh = (
        latest_per_key(bars.select("ticker", "timestamp", roll), ["ticker", "timestamp"], [F.col(roll).desc()])
        .join(known_from, "ticker", "left")
        .filter("_from is null or timestamp >= _from")
        .drop("_from")
        .persist()
    )
    try:
        both = fresh.withColumn("_new", F.lit(1)).unionByName(known.withColumn("_new", F.lit(0)))
        rows = latest_per_key(both, ["ticker", "timestamp"], [F.col("_new").desc()]).drop("_new")
        first_new = fresh.groupBy("ticker").agg(F.min("timestamp").alias("_first"))
        signals = (
            generate_signals(rows, label, entry_threshold, exit_threshold)
            .join(first_new, "ticker")
            .filter("timestamp >= _first")
        )
        due = for_chats(crossings(signals, entry_threshold, exit_threshold), subscriptions(), label, together)
        earliest = fresh.agg(F.to_date(F.min("timestamp"))).scalar()
        sent = read_batches(spark, tables.log, ALERT, missing_ok=True).filter(
            ((F.col("batch_id") < batch_id) | (F.col("feed") != feed)) & (F.col("date") >= earliest)
        )
        write_batch(not_yet_sent(due, sent), tables.log, batch_id, feed)
        _to_keep(rows, lateness, roll).write.mode("overwrite").parquet(
            batch_path(tables.last_bars, batch_id, feed)
        )
        if batch_id > 1:  # a batch that runs again needs the one before it, no earlier one
            nothing = spark.createDataFrame([], _bar_schema(roll))
            nothing.write.mode("overwrite").parquet(batch_path(tables.last_bars, batch_id - 2, feed))
    finally:
        fresh.unpersist()


def start_alerts(
    bars: DataFrame,
    subscriptions: Callable[[], DataFrame],
    tables: AlertTables,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """``subscriptions`` is called in each batch, so new chats are seen."""
    return (
        bars.writeStream.foreachBatch(
            lambda batch, batch_id: alert_batch(batch, batch_id, subscriptions, tables, **options)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": ALERT_TRIGGER}))
        .start()
    )
