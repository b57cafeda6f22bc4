"""Alert events for subscribed chats."""

from collections.abc import Mapping
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.schemas import ENTRY_THRESHOLD, EXIT_THRESHOLD, SIGNAL_WINDOW

#: Chats of a ticker and window that stay together; more are spread over groups of as many.
CHATS_TOGETHER = 10_000


def latest_signal(signals: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """The newest bar of each ticker, at or before ``as_of``."""
    if as_of is not None:
        signals = signals.filter(F.col("timestamp") <= F.lit(as_of))
    newest = F.max_by(F.struct(*signals.columns), F.col("timestamp")).alias("_newest")
    return signals.groupBy("ticker").agg(newest).select("_newest.*")


def crossings(
    signals: DataFrame,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
) -> DataFrame:
    """Bars with a signal, as events. An entry goes before an exit."""
    kind = F.when(F.col("entry_signal"), "entry").when(F.col("exit_signal"), "exit")
    threshold = F.when(F.col("entry_signal"), F.lit(entry_threshold)).otherwise(F.lit(exit_threshold))
    return signals.filter(F.col("entry_signal") | F.col("exit_signal")).select(
        "ticker", "timestamp", kind.alias("kind"), threshold.alias("threshold")
    )


def for_chats(
    events: DataFrame,
    subscriptions: DataFrame,
    label: str | None = SIGNAL_WINDOW,
    together: int = CHATS_TOGETHER,
) -> DataFrame:
    """One alert per event and chat subscribed to this window; with ``label`` None,
    to the window in the event's own ``window`` column. Where chats have a
    ``subscribed_at``, events before it do not concern them.

    Most chats may follow the same ticker. They are counted first, and those of a
    ticker and window with more than ``together`` are spread over as many groups as
    their number asks for, its events being present in every group. Other chats and
    events stay one row. There are fewer such tickers than chats / ``together``, so
    their numbers are broadcast."""
    since = F.col("subscribed_at") if "subscribed_at" in subscriptions.columns else F.lit(None)
    wanted = F.col("subscribed") if label is None else F.col("subscribed") & (F.col("window") == label)
    if label is not None:
        events = events.withColumn("window", F.lit(label))
    key = ["ticker", "window"]
    chats = subscriptions.filter(wanted).select(
        "chat_id", *key, since.cast("timestamp").alias("_since")
    )
    crowds = chats.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / together).alias("_groups")).filter("_groups > 1")
    crowds = F.broadcast(crowds)
    groups = F.coalesce(F.col("_groups"), F.lit(1).cast("long"))
    spread = chats.join(crowds, key, "left").withColumn("_group", F.pmod(F.xxhash64("chat_id"), groups))
    each = F.explode(F.sequence(F.lit(0).cast("long"), groups - 1))
    present = events.join(crowds, key, "left").withColumn("_group", each)
    return (
        spread.drop("_groups").join(present.drop("_groups"), [*key, "_group"])
        .filter(F.col("_since").isNull() | (F.col("timestamp") >= F.col("_since")))
        .select("chat_id", "ticker", "timestamp", "kind", "threshold")
    )


def alerts(
    signals: DataFrame,
    subscriptions: DataFrame,
    as_of: datetime | Column | None = None,
    label: str = SIGNAL_WINDOW,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    together: int = CHATS_TOGETHER,
) -> DataFrame:
    """Alerts due if each ticker's newest bar has a signal."""
    newest = latest_signal(signals, as_of)
    return for_chats(crossings(newest, entry_threshold, exit_threshold), subscriptions, label, together)


def alerts_of_all_windows(
    signals: Mapping[str, DataFrame], subscriptions: DataFrame, **options
) -> DataFrame:
    """Alerts due for every chat at its own window. ``signals`` has the signals
    of each window label, over the bars that window is meant for."""
    due = [alerts(frame, subscriptions, label=label, **options) for label, frame in signals.items()]
    return reduce(DataFrame.unionByName, due)


def not_yet_sent(due: DataFrame, log: DataFrame) -> DataFrame:
    """Leaves out what a chat was already told about this ticker and bar."""
    return due.join(log.select("chat_id", "ticker", "timestamp"), ["chat_id", "ticker", "timestamp"], "left_anti")
