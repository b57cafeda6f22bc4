"""Live tables, streamed parts, and the stateful alert job."""

import pytest
from pyspark.sql import functions as F

from pitflow.functions.shared import shared_folder
from pitflow.operators import alerts as al
from pitflow.operators.sentiment import aggregate_sentiment
from pitflow.plans import research
from pitflow.schemas import ALERT, BAR_INTERVALS, STORED_SCORE
from pitflow.sources import live, tables
from pitflow.sources.bars import resample
from pitflow.streaming import market
from pitflow.streaming import signals as job
from tests.helpers import at, plus, scored

ONCE = {"availableNow": True}
ROW = STORED_SCORE


def versions(spark, rows):
    """(id, ticker, score) at one time each."""
    schema = "id string, ticker string, timestamp timestamp, sentiment_score double"
    return spark.createDataFrame([(i, t, at("10:00"), float(v)) for i, t, v in rows], schema)


def folders(spark, table, part):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/{part}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table.root}/{part}/*/*"))) if system.exists(path) else 0


def values(table, spark):
    return {r.id: r.sentiment_score for r in table.current(spark).collect()}


def test_reads_stay_at_few_folders_and_equal_current(spark):
    table = live.keyed_table(shared_folder(spark, "fifty"), ROW, tables.POST_KEY)
    want = {}
    for batch_id in range(50):
        rows = [(f"p{(batch_id * 7 + k) % 30}", f"T{k % 3}", batch_id) for k in range(4)]
        want.update({i: float(v) for i, _, v in rows})
        table.take(versions(spark, rows), batch_id, fold_every=5)
        if batch_id % 10 == 9:
            assert values(table, spark) == want
    # what is not folded, and what the last generation but one may still need
    assert folders(spark, table, "batches") <= 16 and folders(spark, table, "progress") <= 16
    assert len(table.generations(spark)) <= 2
    assert len(table.rows(spark).inputFiles()) <= 40


def test_a_batch_that_runs_again_counts_once(spark):
    table = market.bucket_part_table(shared_folder(spark, "again"))
    posts = lambda minute, score: scored(spark, [("A", plus("10:00", minute), score)])
    for batch_id in range(4):
        table.take(market.bucket_parts(posts(batch_id, 0.5)), batch_id, fold_every=2)
        if batch_id >= 2:  # the last one again, after what came before it was folded
            table.take(market.bucket_parts(posts(batch_id, 0.25)), batch_id, fold_every=2)
    (row,) = market.buckets_of(table.current(spark)).collect()
    assert (row.post_count, row.avg_sentiment) == (4, pytest.approx(0.375))


def test_unfinished_batches_and_generations_are_not_read(spark):
    table = live.keyed_table(shared_folder(spark, "half"), ROW, tables.POST_KEY)
    table.write(versions(spark, [("a", "A", 1)]), 0)
    tables.mark_started(spark, table.progress, 1)
    tables.write_batch(versions(spark, [("a", "A", 2)]), table.batches, 1, partitions=live.BY_DATE)
    assert values(table, spark) == {"a": 1.0}
    versions(spark, [("b", "A", 9)]).write.parquet(table.base(1))  # a fold that was cut off
    assert values(table, spark) == {"a": 1.0}
    table.fold(spark, {tables.DEFAULT_FEED: 2})
    assert values(table, spark) == {"a": 1.0} and table.generations(spark) == [1]


def test_feeds_keep_their_order_across_folds(spark):
    table = live.keyed_table(shared_folder(spark, "feeds"), ROW, tables.POST_KEY, ("old", "new"))
    table.write(versions(spark, [("a", "A", 5), ("b", "A", 5)]), 0, "new")
    table.fold(spark, {"new": 1})
    table.write(versions(spark, [("a", "A", 1), ("c", "A", 1)]), 0, "old")
    assert values(table, spark) == {"a": 5.0, "b": 5.0, "c": 1.0}
    table.fold(spark, {"old": 1, "new": 1})
    assert values(table, spark) == {"a": 5.0, "b": 5.0, "c": 1.0}
    assert table.position(spark, 2) == {"new": 0, "old": 0}


def test_empty_live_table(spark):
    table = live.keyed_table(shared_folder(spark, "none"), ROW, tables.POST_KEY)
    assert table.current(spark).count() == 0 and table.current(spark).columns == ROW.names
    table.fold(spark, {tables.DEFAULT_FEED: 5})
    table.write(versions(spark, []), 0)
    table.fold(spark, {tables.DEFAULT_FEED: 5})
    assert table.current(spark).count() == 0


def test_a_live_table_reports_its_rows(spark):
    from pyspark.sql import Observation

    table = live.keyed_table(shared_folder(spark, "seen"), ROW, tables.POST_KEY)
    seen = Observation("batch")
    table.take(versions(spark, [("a", "A", 1), ("b", "B", 2)]), 0, observation=seen)
    assert seen.get["rows"] == 2


def test_ingest_reports_what_it_wrote(spark):
    from pitflow.streaming.ingest import PostTables, ingest_batch

    root, told = shared_folder(spark, "told"), []
    post = '{"id":"%s","ticker":"A","timestamp":"2024-01-02T10:00:00Z","source":"news","text":"x"}'
    rows = [(post % "a",), (post % "a",), (post % "b",), ("{bad",)]
    records = spark.createDataFrame(rows, "value string")
    score = lambda posts: posts.selectExpr("*", *(f"0.5D AS {c}" for c in ("positive", "neutral", "negative", "sentiment_score")))
    target = PostTables(*(f"{root}/{n}" for n in ("raw", "scored", "rejected", "progress")))
    ingest_batch(records, 3, target, score, report=lambda batch_id, rows: told.append((batch_id, rows)))
    ingest_batch(records.limit(0), 4, target, score, report=lambda batch_id, rows: told.append((batch_id, rows)))
    assert told == [(3, {"rejected": 1, "raw": 2, "scored": 2}), (4, {"rejected": 0, "raw": 0, "scored": 0})]


def test_chats_of_a_crowded_ticker_are_spread_by_their_number(spark):
    chats = [(i, "A" if i < 900 else f"T{i % 9}", "1h", True) for i in range(1000)]
    subscriptions = spark.createDataFrame(chats, "chat_id long, ticker string, window string, subscribed boolean")
    events = [(t, at("10:00"), "entry", 0.4) for t in ["A", *(f"T{k}" for k in range(9))]]
    signals = spark.createDataFrame(events, "ticker string, timestamp timestamp, kind string, threshold double")
    whole = sorted(map(tuple, al.for_chats(signals, subscriptions).collect()))
    spread = al.for_chats(signals, subscriptions, together=50)
    assert sorted(map(tuple, spread.collect())) == whole and len(whole) == 1000
    plan = spread._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scores_of_any_size_end_no_job(spark):
    from pitflow.operators.signals import add_rolling_sentiment

    rows = [("A", plus("10:00", 15 * i), v) for i, v in enumerate([0.5, 2500.0, None, float("nan"), 0.1])]
    aligned = spark.createDataFrame(rows, "ticker string, timestamp timestamp, avg_sentiment double")
    got = [r.sentiment_roll_1h for r in add_rolling_sentiment(aligned).orderBy("timestamp").collect()]
    assert got == [0.5, 0.5, 0.5, 0.5, 0.1]  # what is no score counts as missing


def test_parts_of_any_split_give_the_batch_aggregates(spark):
    rows = [("AB"[i % 2], plus("10:00", 4 * i % 97), None if i % 11 == 0 else i / 50 - 1) for i in range(100)]
    rows += [(None, at("10:00"), 1.0), ("A", None, 1.0), ("A", at("10:03"), float("nan"))]
    posts = scored(spark, rows)
    parts = [market.bucket_parts(posts.filter(F.pmod(F.xxhash64("timestamp", "id"), F.lit(3)) == k)) for k in range(3)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = market.buckets_of(market.merged_buckets(union)).orderBy("ticker", "timestamp").collect()
    want = aggregate_sentiment(posts).select(*got[0].asDict()).orderBy("ticker", "timestamp").collect()
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:2] == w[:2] and g.post_count == w.post_count
        assert [g.avg_sentiment, g.avg_positive, g.avg_negative] == pytest.approx([w.avg_sentiment, w.avg_positive, w.avg_negative])


def test_bars_of_ties_and_late_ticks(spark):
    schema = "tick_id long, ticker string, timestamp timestamp, price double, size double"
    first = spark.createDataFrame([(5, "A", at("10:01"), 2.0, 1.0), (9, "A", at("10:14"), 3.0, 1.0)], schema)
    late = spark.createDataFrame(
        [(4, "A", at("10:01"), 1.5, 2.0), (8, "A", at("10:14"), 9.0, 1.0), (1, "B", at("10:20"), 7.0, 1.0)], schema
    )
    table = market.bar_part_table(shared_folder(spark, "bars"))
    table.write(market.bar_parts(first, "15m"), 0)
    table.write(market.bar_parts(late, "15m"), 1)
    want = sorted(map(str, resample(first.unionByName(late), "15m").collect()))
    assert sorted(map(str, market.bars_of(table.current(spark)).collect())) == want
    table.fold(spark, {tables.DEFAULT_FEED: 2})
    assert sorted(map(str, market.bars_of(table.current(spark)).collect())) == want


# --- the stateful job ---------------------------------------------------------


def market_rows(n, step=7):
    """Posts and ticks of two tickers; scores swing, so that both thresholds are crossed."""
    posts = [("AB"[i % 2], plus("00:00", step * i), (((i * 37) % 61) / 30 - 1)) for i in range(n)]
    ticks = [(i, "AB"[(i // 3) % 2], plus("00:00", step * i + 2), 100.0 + i % 5, 1.0) for i in range(n)]
    return posts, ticks


TICKS = "tick_id long, ticker string, timestamp timestamp, price double, size double"


def expected(spark, posts, ticks, chats):
    due = None
    for label, interval in BAR_INTERVALS.items():
        frame = research.trading_signals(scored(spark, posts), resample(spark.createDataFrame(ticks, TICKS), interval), label)
        own = al.for_chats(al.crossings(frame), chats, label)
        due = own if due is None else due.unionByName(own)
    return sorted(map(tuple, due.collect()))


class Feed:
    """Files of posts and ticks, and the job run over what is new."""

    def __init__(self, spark, chats, lateness="1d"):
        self.spark, self.chats, self.lateness = spark, chats, lateness
        self.root = shared_folder(spark, "feed")
        self.target = job.SignalTables(f"{self.root}/log", f"{self.root}/late")

    def run(self, posts, ticks):
        spark = self.spark
        frames = {"posts": scored(spark, posts), "ticks": spark.createDataFrame(ticks, TICKS)}
        for name, frame in frames.items():
            frame.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")
        streams = [spark.readStream.schema(frame.schema).parquet(f"{self.root}/{name}") for name, frame in frames.items()]
        job.start_market_alerts(
            *streams, lambda: self.chats, self.target, f"{self.root}/checkpoint", ONCE, lateness=self.lateness
        ).awaitTermination()

    def log(self):
        rows = tables.read_batches(self.spark, self.target.log, ALERT)
        return sorted(map(tuple, rows.select("chat_id", "ticker", "timestamp", "kind", "threshold").collect()))

    def late(self):
        return self.spark.read.parquet(self.target.late).agg(F.sum("rows")).first()[0] or 0


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(i, "AB"[i % 2], w, True, None) for i, w in enumerate(["15m", "1h", "4h", "24h"] * 2 + ["1h"])]
    rows += [(20, "A", "1h", False, None), (21, "A", "15m", True, plus("00:00", 900))]
    return spark.createDataFrame(
        rows, "chat_id long, ticker string, window string, subscribed boolean, subscribed_at timestamp"
    )


def test_job_equals_the_batch_over_restarts(spark, chats):
    posts, ticks = market_rows(900)
    feed = Feed(spark, chats)
    for a, b in ((0, 300), (300, 301), (301, 900)):
        feed.run(posts[a:b], ticks[a:b])
    want = expected(spark, posts, ticks, chats)
    assert feed.log() == want and len({r[0] for r in want}) >= 6
    assert feed.late() == 0


def test_late_rows_take_their_place_or_are_counted(spark, chats):
    posts, ticks = market_rows(120)
    feed = Feed(spark, chats, lateness="4h")
    kept = [p for p in posts if p[1] < plus("00:00", 600) or p[1] > plus("00:00", 640)]
    feed.run(kept, ticks)
    before = feed.log()
    feed.run([p for p in posts if p not in kept], ticks[:1])
    after = feed.log()
    # what was told stays told, what is known now is told, and the first tick is days behind
    assert set(before) <= set(after) and feed.late() >= 1
    recent = plus("00:00", 661).replace(tzinfo=None)
    want = [r for r in expected(spark, posts, ticks, chats) if r[2] >= recent]
    assert set(want) <= set(after)


def test_series_alone_against_all_rows_at_once():
    import numpy as np
    import pandas as pd

    hour = 3_600_000_000
    rng = np.random.default_rng(1)
    bars = pd.DataFrame({"kind": job.BAR, "us": np.sort(rng.choice(4000, 600, replace=False)) * hour // 4, "total": 0.0, "many": 0})
    ends = np.sort(rng.choice(4000, 900)) * hour // 4
    posts = pd.DataFrame({"kind": job.BUCKET, "us": ends, "total": rng.uniform(-1, 1, 900), "many": 1})
    rows = pd.concat([bars, posts]).sort_values("us", kind="stable")

    def told(step):
        row, out, most = None, [], 0
        for start in range(0, len(rows), step):
            series = job.Series(["1h", "4h"], 24 * hour, 0.4, -0.2, row)
            since, late = series.add(rows.iloc[start : start + step])
            assert late == 0
            out += list(series.crossings(since)) if since is not None else []
            series.forget()
            row, most = series.row(), max(most, len(series.bars))
        return sorted(out), most

    whole, _ = told(len(rows))
    by_step, most = told(13)
    assert len(whole) > 50 and set(whole) <= set(by_step) and most < 80
