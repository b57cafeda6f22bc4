"""From a stream of scored posts and ticks to alerts, each chat at its own window.

One stateful operator holds, for each ticker and bar interval, the last bars and
buckets: what rolling means, crossings and the as-of match of new bars still
need. Posts and ticks are added up within each Arrow batch before they are
shuffled, so a ticker with most of the posts sends a few rows per batch of them.
"""

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pitflow.functions.cells import placed
from pitflow.functions.durations import bucket_us, duration_us
from pitflow.functions.rocks import with_rocks
from pitflow.functions.text import not_nan
from pitflow.operators.alerts import CHATS_TOGETHER, for_chats
from pitflow.schemas import ALERT_TRIGGER, BAR_INTERVALS, BUCKET_WINDOW, ENTRY_THRESHOLD, EXIT_THRESHOLD
from pitflow.sources.tables import DEFAULT_FEED, batch_path, write_batch
from pitflow.streaming.alerts import LATENESS

BAR, BUCKET = "bar", "bucket"
PARTS = "ticker string, interval string, kind string, us long, total double, many long"
OUTPUT = "ticker string, window string, us long, kind string, threshold double, late long"
STATE = "bars binary, ends binary, totals binary, counts binary, sent binary, newest long"
#: Fixed point of scores, as the batch has it: sums do not depend on their order.
EXACT, LARGEST = 10**15, 1000.0


@dataclass(frozen=True)
class SignalTables:
    log: str
    late: str


# --- before the shuffle --------------------------------------------------------


def added_up(rows: DataFrame, kind: str, interval: str, bucket: str) -> DataFrame:
    """PARTS of ``rows`` (ticker, us, score): per ticker and window one row from each
    Arrow batch. Bars are stamped at their window's start, buckets at its end."""
    width = bucket_us(bucket if kind == BUCKET else interval)
    shift = width if kind == BUCKET else 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us = batch["us"].to_numpy()
            table = pa.table(
                {"ticker": batch["ticker"], "us": us - us % width + shift, "score": batch["score"]}
            )
            parts = table.group_by(["ticker", "us"]).aggregate([("score", "sum"), ("score", "count")])
            n = len(parts)
            yield pa.RecordBatch.from_pydict(
                {
                    "ticker": parts["ticker"].combine_chunks(),
                    "interval": pa.array([interval] * n, pa.string()),
                    "kind": pa.array([kind] * n, pa.string()),
                    "us": parts["us"].combine_chunks(),
                    "total": pc.fill_null(parts["score_sum"], 0.0).combine_chunks(),
                    "many": parts["score_count"].combine_chunks(),
                }
            )

    return rows.mapInArrow(task, PARTS)


def market_parts(
    scored: DataFrame, ticks: DataFrame, intervals: Mapping[str, str] = BAR_INTERVALS, bucket: str = BUCKET_WINDOW
) -> DataFrame:
    """Posts and ticks as parts, for each of the bar intervals."""
    us = F.unix_micros(F.col("timestamp").cast("timestamp")).alias("us")
    posts = placed(scored).select("ticker", us, not_nan(F.col("sentiment_score")).alias("score"))
    bars = placed(ticks).select("ticker", us, F.lit(None).cast("double").alias("score"))
    parts = None
    for interval in dict.fromkeys(intervals.values()):
        for rows, kind in ((posts, BUCKET), (bars, BAR)):
            own = added_up(rows, kind, interval, bucket)
            parts = own if parts is None else parts.unionByName(own)
    return parts


# --- the state of a ticker ----------------------------------------------------------


class Series:
    """The last bars and buckets of a ticker at one bar interval. Times are in
    microseconds, sorted."""

    def __init__(self, labels: list[str], lateness: int, entry: float, exit_: float, row: tuple | None = None):
        self.windows = [duration_us(label) for label in labels]
        self.lateness, self.entry, self.exit = lateness, entry, exit_
        if row is None:
            row = (b"", b"", b"", b"", b"", None)
        bars, ends, totals, counts, sent, self.newest = row
        self.bars, self.ends, self.counts = (np.frombuffer(b, np.int64) for b in (bars, ends, counts))
        self.totals = np.frombuffer(totals, np.float64)
        # (window, bar, kind) of what was told
        self.sent = {tuple(r) for r in np.frombuffer(sent, np.int64).reshape(-1, 3).tolist()}

    def row(self) -> tuple:
        sent = np.array(sorted(self.sent), np.int64).reshape(-1, 3)
        arrays = (self.bars, self.ends, self.totals, self.counts, sent)
        return (*(a.tobytes() for a in arrays), self.newest)

    @property
    def horizon(self) -> int | None:
        """Older bars and buckets come too late."""
        return None if self.newest is None else self.newest - self.lateness

    def add(self, parts: pd.DataFrame) -> tuple[int | None, int]:
        """Takes bars and buckets in. The first bar that they can change, and how
        many rows came too late."""
        late = 0
        if self.horizon is not None:
            old = parts["us"] < self.horizon
            late = int(old.sum())
            parts = parts[~old]
        bars = parts.loc[parts["kind"] == BAR, "us"].to_numpy(np.int64)
        fresh = np.setdiff1d(bars, self.bars)
        self.bars = np.union1d(self.bars, fresh)
        posts = parts[(parts["kind"] == BUCKET) & (parts["many"] > 0)]
        ends, at = np.unique(np.concatenate([self.ends, posts["us"].to_numpy(np.int64)]), return_inverse=True)
        totals = np.concatenate([self.totals, posts["total"].to_numpy(np.float64)])
        counts = np.concatenate([self.counts, posts["many"].to_numpy(np.int64)])
        self.ends = ends
        self.totals = np.bincount(at, totals, minlength=len(ends))
        self.counts = np.bincount(at, counts, minlength=len(ends)).astype(np.int64)
        if len(self.bars):
            self.newest = int(self.bars[-1])
        touched = [int(x.min()) for x in (fresh, posts["us"].to_numpy(np.int64) + 1) if len(x)]
        return min(touched, default=None), late

    def means(self, window: int) -> np.ndarray:
        """Trailing means over (t - window, t] of the last bucket before each bar."""
        at = np.searchsorted(self.ends, self.bars, side="left") - 1
        seen = at >= 0
        values = np.zeros(len(self.bars))
        values[seen] = self.totals[at[seen]] / self.counts[at[seen]]
        usable = np.abs(values) < LARGEST
        exact = [round(v * EXACT) if u else 0 for v, u in zip(values.tolist(), usable)]
        totals = np.concatenate([[0], np.cumsum(np.array(exact, dtype=object))])
        many = np.concatenate([[0], np.cumsum(usable)])
        first = np.searchsorted(self.bars, self.bars - window, side="right")
        upto = np.arange(1, len(self.bars) + 1)
        total, n = totals[upto] - totals[first], many[upto] - many[first]
        return np.array([t / (k * EXACT) if k else np.nan for t, k in zip(total, n)], dtype=np.float64)

    def crossings(self, since: int) -> Iterator[tuple[int, int, str]]:
        """(number of the window, bar, kind) of the crossings from ``since`` on that
        were not told yet."""
        for number, window in enumerate(self.windows):
            now = self.means(window)
            before = np.concatenate([[np.nan], now[:-1]])
            up = (now > self.entry) & (before <= self.entry)
            down = (now < self.exit) & (before >= self.exit)
            for i in np.flatnonzero((up | down) & (self.bars >= since)):
                told = (number, int(self.bars[i]), int(up[i]))
                if told not in self.sent:
                    self.sent.add(told)
                    yield number, int(self.bars[i]), "entry" if up[i] else "exit"

    def forget(self) -> None:
        """Drops what no bar within the horizon needs: older bars than the widest
        window before the last bar in front of it, and buckets that none of the
        bars left can see."""
        if not len(self.bars):
            return
        in_front = max(0, int(np.searchsorted(self.bars, self.horizon, side="left")) - 1)
        keep_from = int(self.bars[in_front]) - max(self.windows)
        self.bars = self.bars[np.searchsorted(self.bars, keep_from, side="right") :]
        seen = max(0, int(np.searchsorted(self.ends, self.bars[0], side="left")) - 1)
        self.ends, self.totals, self.counts = (x[seen:] for x in (self.ends, self.totals, self.counts))
        self.sent = {told for told in self.sent if told[1] >= self.horizon}


class Crossings(StatefulProcessor):
    """Keeps a ``Series`` per ticker and interval, and tells its new crossings."""

    def __init__(self, labels: Mapping[str, list[str]], lateness: int, entry: float, exit_: float):
        self.labels, self.lateness, self.entry, self.exit = labels, lateness, entry, exit_

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("series", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ticker, interval = key
        labels = self.labels[interval]
        stored = self.state.get() if self.state.exists() else None
        series = Series(labels, self.lateness, self.entry, self.exit, stored and tuple(stored))
        since, late = series.add(pd.concat(list(rows)))
        told = []
        if since is not None:
            for number, us, kind in series.crossings(since):
                threshold = self.entry if kind == "entry" else self.exit
                told.append((ticker, labels[number], us, kind, threshold, None))
            series.forget()
            self.state.update(series.row())
        if late:
            told.append((ticker, interval, None, "late", None, late))
        if told:
            frame = pd.DataFrame(told, columns=[c.split()[0] for c in OUTPUT.split(", ")])
            yield frame.astype({"us": "Int64", "late": "Int64", "threshold": "float64"})

    def close(self) -> None:
        pass


# --- the job --------------------------------------------------------------------


def told_batch(
    told: DataFrame,
    batch_id: int,
    subscriptions: Callable[[], DataFrame],
    tables: SignalTables,
    feed: str = DEFAULT_FEED,
    together: int = CHATS_TOGETHER,
) -> None:
    """A batch of crossings to the chats of their ticker and window, and the numbers
    of rows that came too late to the reject table. Both folders are replaced when a
    batch runs again."""
    told = told.persist()
    try:
        events = told.filter("kind != 'late'").select(
            "ticker", "window", F.timestamp_micros("us").alias("timestamp"), "kind", "threshold"
        )
        write_batch(for_chats(events, subscriptions(), None, together), tables.log, batch_id, feed)
        late = told.filter("kind = 'late'").select("ticker", F.col("window").alias("interval"), F.col("late").alias("rows"))
        late.write.mode("overwrite").parquet(batch_path(tables.late, batch_id, feed))
    finally:
        told.unpersist()


def start_market_alerts(
    scored: DataFrame,
    ticks: DataFrame,
    subscriptions: Callable[[], DataFrame],
    tables: SignalTables,
    checkpoint: str,
    trigger: dict | None = None,
    intervals: Mapping[str, str] = BAR_INTERVALS,
    bucket: str = BUCKET_WINDOW,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    lateness: str = LATENESS,
    feed: str = DEFAULT_FEED,
    together: int = CHATS_TOGETHER,
) -> StreamingQuery:
    """Alerts from streams of scored posts and of ticks (ticker, timestamp).

    ``intervals`` has the bars of each chat window. A crossing is told once, when
    the bar is first seen to cross; posts and ticks up to ``lateness`` behind a
    ticker's newest bar take their place, and what they change is told from there
    on. Later ones are counted in the reject table. Chats are read anew in each
    batch. State is in the checkpoint, so a restarted job goes on where it was."""
    labels: dict[str, list[str]] = {}
    for label, interval in intervals.items():
        labels.setdefault(interval, []).append(label)
    processor = Crossings(labels, duration_us(lateness), entry_threshold, exit_threshold)
    parts = market_parts(scored, ticks, intervals, bucket)
    told = parts.groupBy("ticker", "interval").transformWithStateInPandas(processor, OUTPUT, "Update", "None")

    def batch(rows: DataFrame, batch_id: int) -> None:
        told_batch(rows, batch_id, subscriptions, tables, feed, together)

    writer = (
        told.writeStream.outputMode("update")
        .foreachBatch(batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": ALERT_TRIGGER}))
    )
    return with_rocks(scored.sparkSession, writer.start)
