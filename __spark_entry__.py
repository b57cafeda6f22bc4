
from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

import oracle
from pitflow import fixtures
from pitflow.functions.rocks import with_rocks
from pitflow.functions.shared import shared_folder
from pitflow.operators import alerts as al
from pitflow.operators import asof, backtest, scoring, sentiment, signals, views
from pitflow.plans import research
from pitflow.schemas import ALERT, BAR_INTERVALS, BUCKET, SCORED_POST, SIGNAL_ROW, STORED_SCORE
from pitflow.sources import bars as bar_source
from pitflow.sources import posts as post_source
from pitflow.sources import live, tables
from pitflow.streaming import alerts as alert_job
from pitflow.streaming import backtests as backtest_job
from pitflow.streaming import buckets as bucket_job
from pitflow.streaming import ingest as ingest_job
from pitflow.streaming import market
from pitflow.streaming import signals as signal_job

try:
    import corpus_pipeline
    from pitflow.llm import queries as llm
except ImportError:  # the subpackage or a library that it needs is not there
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

ONCE = {"availableNow": True}
UNIVERSE = ["CLICK", "VIEW", "ERROR", "PURCHASE"]


class Inputs:
    """The driver's tables as posts, ticks and bars."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        # Windows, dates and timestamp strings are all meant in UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self.events = fixtures.events(spark, sf_dir)

    def posts(self, ticker: str = "event_type") -> DataFrame:
        return fixtures.posts(self.events, ticker)

    def bars(self, interval: str, ticker: str = "event_type") -> DataFrame:
        return bar_source.resample(fixtures.ticks(self.events, ticker), interval)

    def document_posts(self) -> DataFrame:
        return fixtures.document_posts(fixtures.documents(self.spark, self.sf_dir))

    def scored_documents(self) -> DataFrame:
        return lexicon_scored(self.document_posts())

    def wire(self) -> DataFrame:
        return fixtures.wire_posts(self.posts())

    def provider_bars(self) -> DataFrame:
        """15-minute bars as a provider names them, some without a positive close."""
        raw = self.bars("15m").withColumn("close", F.col("close") - F.lit(101.0))
        return raw.select(
            F.col("ticker").alias("Symbol"),
            F.col("timestamp").alias("Datetime"),
            F.col("open").alias("Open"),
            F.col("high").alias("High"),
            F.col("low").alias("Low"),
            F.col("close").alias("Close"),
            F.col("volume").alias("Volume"),
        )

    def resent_posts(self) -> DataFrame:
        """Clicks again, a day later and turned round, and views as new posts."""
        posts = self.posts()
        moved = posts.filter("ticker = 'click'").withColumns(
            {
                "timestamp": F.col("timestamp") + F.expr("interval 1 day"),
                "sentiment_score": -F.col("sentiment_score"),
            }
        )
        added = posts.filter("ticker = 'view'").withColumn("id", F.concat(F.lit("v"), "id"))
        return moved.unionByName(added)

    def stream(self, table: str) -> DataFrame:
        """A table in one file or in a folder of files. The path is a glob that fits
        nothing else, as a stream refuses the plain path of a file."""
        schema = fixtures.read(self.spark, self.sf_dir, table).schema
        reader = self.spark.readStream.schema(schema).option("basePath", self.sf_dir)
        return reader.parquet(f"{self.sf_dir}/{table}.parque[t]")


def lexicon_scored(posts: DataFrame) -> DataFrame:
    return scoring.score_texts(posts, fixtures.POSITIVE_WORDS, fixtures.NEGATIVE_WORDS)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, so that engines adding in different
    orders agree."""

    def output(name: str, dtype: str) -> Column:
        return F.round(name, places).alias(name) if dtype == "double" else F.col(name)

    return df.select(*[output(name, dtype) for name, dtype in df.dtypes])


# --- posts -----------------------------------------------------------------


def parse_posts(spark, sf_dir):
    return post_source.parse_posts(Inputs(spark, sf_dir).wire())


def validate_posts(spark, sf_dir):
    return post_source.valid_posts(Inputs(spark, sf_dir).wire())


def rejected_posts(spark, sf_dir):
    return post_source.rejected_posts(Inputs(spark, sf_dir).wire())


def serialize_posts(spark, sf_dir):
    posts = Inputs(spark, sf_dir).posts().select("id", "ticker", "timestamp", "source", "text")
    return post_source.serialize_posts(posts).select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value")
    )


def posts_by_date(spark, sf_dir):
    dated = post_source.with_date(Inputs(spark, sf_dir).posts())
    return dated.groupBy("ticker", F.col("date").cast("string").alias("date")).agg(
        F.count(F.lit(1)).alias("posts")
    )


def dedupe_posts(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    both = inputs.posts().unionByName(inputs.resent_posts())
    return rounded(sentiment.dedupe_posts(both).select("id", "ticker", "timestamp", "sentiment_score"))


def upsert_posts(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    merged = tables.upsert(inputs.posts(), inputs.resent_posts(), tables.POST_KEY)
    return rounded(merged.select("id", "ticker", "timestamp", "sentiment_score"))


def label_posts(spark, sf_dir):
    labelled = sentiment.label_posts(Inputs(spark, sf_dir).posts())
    return rounded(labelled.select("id", "sentiment_score", "label"))


def normalize_ticker(spark, sf_dir):
    """Tickers as typed by users: lower case, with one or two dollar signs."""
    posts = Inputs(spark, sf_dir).posts()
    typed = F.concat(F.when(F.col("source") == "news", "$$").otherwise("$"), F.col("ticker"))
    return sentiment.normalize_tickers(posts.select("id", typed.alias("ticker")), UNIVERSE)


def tickers(spark, sf_dir):
    return sentiment.tickers(Inputs(spark, sf_dir).posts("user_id"))


def recent_posts(spark, sf_dir):
    recent = sentiment.recent_posts(Inputs(spark, sf_dir).posts("user_id"))
    return rounded(recent.select("ticker", "id", "timestamp", "source", "sentiment_score", "rank"))


def recent_posts_one_ticker(spark, sf_dir):
    recent = sentiment.recent_posts(Inputs(spark, sf_dir).posts(), ticker="click")
    return rounded(recent.select("ticker", "id", "timestamp", "source", "sentiment_score"))


def post_feed(spark, sf_dir):
    return sentiment.post_feed(Inputs(spark, sf_dir).document_posts(), score=lexicon_scored)


# --- scoring ---------------------------------------------------------------


def score_posts(spark, sf_dir):
    return rounded(Inputs(spark, sf_dir).scored_documents().drop("text"))


def score_posts_udf(spark, sf_dir):
    factory = scoring.lexicon_scorer(fixtures.POSITIVE_WORDS, fixtures.NEGATIVE_WORDS)
    posts = Inputs(spark, sf_dir).document_posts()
    return rounded(scoring.score_with(posts, factory).drop("text"))


# --- bars ------------------------------------------------------------------


def ohlcv(interval: str) -> Query:
    return lambda spark, sf_dir: rounded(Inputs(spark, sf_dir).bars(interval))


def normalize_bars(spark, sf_dir):
    raw = Inputs(spark, sf_dir).provider_bars()
    as_of = datetime(2024, 1, 31, tzinfo=timezone.utc)
    return rounded(bar_source.normalize_bars(raw, ["click", "view", "error"], "10d", as_of))


def rejected_bars(spark, sf_dir):
    return rounded(bar_source.rejected_bars(Inputs(spark, sf_dir).provider_bars()))


def upsert_bars(spark, sf_dir):
    bars = Inputs(spark, sf_dir).bars("1h")
    corrected = bars.filter("ticker = 'click'").withColumn("close", F.col("close") + 1)
    later = bars.filter("ticker = 'view'").withColumn(
        "timestamp", F.col("timestamp") + F.expr("interval 60 days")
    )
    merged = tables.upsert(bars, corrected.unionByName(later), ("ticker", "timestamp"))
    return rounded(merged)


def bar_spacing(ticker: str) -> Query:
    return lambda spark, sf_dir: bar_source.bar_spacing(Inputs(spark, sf_dir).bars("15m", ticker))


# --- buckets, as-of, signals -----------------------------------------------


def buckets(window: str) -> Query:
    return lambda spark, sf_dir: rounded(
        sentiment.aggregate_sentiment(Inputs(spark, sf_dir).posts(), window)
    )


def asof_align(interval: str, ticker: str = "event_type") -> Query:
    def run(spark, sf_dir):
        inputs = Inputs(spark, sf_dir)
        return rounded(
            asof.align_sentiment_with_price(inputs.posts(ticker), inputs.bars(interval, ticker))
        )

    return run


def rolling_sentiment(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    aligned = asof.align_sentiment_with_price(inputs.posts(), inputs.bars("15m"))
    rolled = signals.add_rolling_sentiment(aligned.select("ticker", "timestamp", "avg_sentiment"))
    return rounded(rolled)


def signals_15m(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    aligned = asof.align_sentiment_with_price(inputs.posts(), inputs.bars("15m"))
    rolled = signals.add_rolling_sentiment(
        aligned.select("ticker", "timestamp", "avg_sentiment"), ("15m",)
    )
    return rounded(signals.generate_signals(rolled, "15m"))


def signal_frame(interval: str, label: str, ticker: str = "event_type") -> Query:
    def run(spark, sf_dir):
        inputs = Inputs(spark, sf_dir)
        return rounded(
            research.signal_frame(inputs.posts(ticker), inputs.bars(interval, ticker), label)
        )

    return run


def stored_series(inputs: Inputs) -> research.StoredSeries:
    """1h bars and buckets of users in a cell table: some first with wrong values, then
    all of them, the wrong ones put right."""
    path = shared_folder(inputs.spark, "series")
    series = research.StoredSeries.at(path.rsplit("/", 1)[1].replace("-", "_"), path, "24h", groups=8)
    rows = (
        (series.add_bars, inputs.bars("1h", "user_id"), "close"),
        (series.add_buckets, sentiment.aggregate_sentiment(inputs.posts("user_id")), "avg_sentiment"),
    )
    for add, frame, value in rows:
        wrong = frame.filter(F.hour("timestamp") % 3 == 0).withColumn(value, F.col(value) * 2 + 1)
        add(wrong, 0)
        add(frame, 1)
    return series


def asof_stored(spark, sf_dir):
    return rounded(stored_series(Inputs(spark, sf_dir)).asof_align(spark))


def signal_frame_stored(spark, sf_dir):
    return rounded(stored_series(Inputs(spark, sf_dir)).signal_frame(spark, "4h"))


def latest_signal(spark, sf_dir):
    frame = Inputs(spark, sf_dir)
    return rounded(al.latest_signal(research.signal_frame(frame.posts(), frame.bars("1h"))))


def chart_series(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    closes = inputs.bars("1h").select("ticker", "timestamp", "close")
    frame = research.signal_frame(inputs.posts(), closes, windows=("1h",))
    return rounded(views.chart_series(frame))


# --- backtest --------------------------------------------------------------


def backtest_summary(interval: str, label: str, ticker: str = "event_type") -> Query:
    def run(spark, sf_dir):
        inputs = Inputs(spark, sf_dir)
        figures = research.backtest(inputs.posts(ticker), inputs.bars(interval, ticker), label)
        return backtest.summary_view(figures)

    return run


def equity(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return research.equity(inputs.posts(), inputs.bars("15m"), "15m", cash=1.0)


def equity_curve(spark, sf_dir):
    return rounded(equity(spark, sf_dir).select("ticker", "timestamp", "position", "value", "cumulative_return"))


def benchmark_curve(spark, sf_dir):
    return rounded(backtest.benchmark_curve(Inputs(spark, sf_dir).bars("15m")))


def drawdown(spark, sf_dir):
    return rounded(equity(spark, sf_dir).select("ticker", "timestamp", "drawdown"))


def returns_series(spark, sf_dir):
    return rounded(views.returns_series(equity(spark, sf_dir)), 4)


# --- alerts ----------------------------------------------------------------


#: An instant within the test tables.
ALERT_TIME = datetime(2024, 1, 16, 12, tzinfo=timezone.utc)


def _alerts(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    posts, frames = inputs.posts(), {}
    for interval in dict.fromkeys(BAR_INTERVALS.values()):
        bars, windows = inputs.bars(interval), [w for w, i in BAR_INTERVALS.items() if i == interval]
        for label in windows:
            frames[label] = research.trading_signals(posts, bars, label, windows=windows)
    chats = fixtures.subscriptions(inputs.events)
    return al.alerts_of_all_windows(frames, chats, as_of=ALERT_TIME), chats


def alerts(spark, sf_dir):
    """Every chat at its own window, with that window's bars."""
    return _alerts(spark, sf_dir)[0]


def alerts_new(spark, sf_dir):
    """Chats with an id divisible by four have had this alert already."""
    due, chats = _alerts(spark, sf_dir)
    log = due.join(chats.filter("chat_id % 4 = 0").select("chat_id"), "chat_id", "left_semi")
    return al.not_yet_sent(due, log)


def alert_history(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    return al.crossings(research.trading_signals(inputs.posts(), inputs.bars("1h")))


# --- tables and streams ----------------------------------------------------


def stored_posts(spark, sf_dir):
    """A batch compacted to a base, and a later batch, written twice, over it."""
    inputs = Inputs(spark, sf_dir)
    root, base = shared_folder(spark, "posts"), shared_folder(spark, "base")
    tables.write_batch(inputs.posts(), root, 0)
    tables.compact(tables.current(tables.read_batches(spark, root, SCORED_POST), tables.POST_KEY), base)
    tables.write_batch(inputs.posts(), root, 1)
    tables.write_batch(inputs.resent_posts(), root, 1)
    batches = tables.read_batches(spark, root, SCORED_POST)
    later = tables.current(batches.filter("batch_id > 0"), tables.POST_KEY)
    stored = tables.over_base(tables.read_batches(spark, base, SCORED_POST), later, tables.POST_KEY)
    return rounded(stored.select("id", "ticker", "timestamp", "sentiment_score"))


def compacted_posts(spark, sf_dir):
    """The table of two batches, compacted."""
    inputs = Inputs(spark, sf_dir)
    root, compacted = shared_folder(spark, "posts"), shared_folder(spark, "compacted")
    tables.write_batch(inputs.posts(), root, 0)
    tables.write_batch(inputs.resent_posts(), root, 1)
    stored = tables.current(tables.read_batches(spark, root, SCORED_POST), tables.POST_KEY)
    tables.compact(stored, compacted)
    rows = tables.read_batches(spark, compacted, SCORED_POST)
    return rounded(rows.select("id", "ticker", "timestamp", "sentiment_score"))


def ingest_stream(spark, sf_dir):
    """Documents through the bus format into the scored table."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "ingest")
    records = fixtures.wire_posts(fixtures.document_posts(inputs.stream("documents")))
    target = ingest_job.PostTables(f"{root}/raw", f"{root}/scored", f"{root}/rejected", f"{root}/progress")
    ingest_job.start_ingest(
        records, target, lexicon_scored, f"{root}/checkpoint", ONCE, in_place=True
    ).awaitTermination()
    batches = tables.read_batches(spark, target.scored, SCORED_POST)
    stored = tables.current(tables.finished_batches(batches, target.progress), tables.POST_KEY)
    return rounded(stored.drop("text", "feed", "batch_id", "date"))


def bucket_stream(spark, sf_dir):
    """Final buckets, as a stream in append mode gives them."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "buckets")
    events = inputs.stream("events").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = bucket_job.bucket_stream(fixtures.posts(events))
    (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**ONCE)
        .start(f"{root}/buckets")
        .awaitTermination()
    )
    return rounded(spark.read.schema(stream.schema).parquet(f"{root}/buckets"))


def slices(rows: DataFrame, *overlaps: str) -> Iterator[DataFrame]:
    """All rows in three slices in the order of time, each later one beginning its
    overlap before the end of the one before; rows without a time are in the first."""
    bounds = [F.lit(day).cast("timestamp") for day in ("2024-01-11", "2024-01-21")]
    starts = [bound - F.expr(f"interval {overlap}") for bound, overlap in zip(bounds, overlaps)]
    at = F.col("timestamp")
    yield rows.filter((at < bounds[0]) | at.isNull())
    yield rows.filter((at >= starts[0]) & (at < bounds[1]))
    yield rows.filter(at >= starts[1])


def streamed(parts: Iterator[DataFrame], path: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Each part written to ``path``, in as many files as it has, and then taken
    as one batch by a run of the stream that ``start`` starts."""
    for part in parts:
        part.write.mode("append").parquet(path)
        start(part.sparkSession.readStream.schema(part.schema).parquet(path)).awaitTermination()


def bucket_table(spark, sf_dir):
    """All buckets, kept by a stream in update mode over three slices."""
    root = shared_folder(spark, "bucket-table")
    posts = Inputs(spark, sf_dir).posts()

    def start(stream: DataFrame) -> StreamingQuery:
        return bucket_job.start_bucket_table(stream, f"{root}/table", f"{root}/checkpoint", trigger=ONCE)

    streamed(slices(posts, "0 minutes", "0 minutes"), f"{root}/posts", start)
    stored = tables.current(tables.read_batches(spark, f"{root}/table", BUCKET), tables.BAR_KEY)
    return rounded(stored.select(*BUCKET.names))


def dedupe_stream(spark, sf_dir):
    """Three slices, the last half hour of one sent again in the next."""
    root = shared_folder(spark, "dedupe")
    posts = Inputs(spark, sf_dir).posts().select("id", "ticker", "timestamp", "source")

    def start(stream: DataFrame) -> StreamingQuery:
        writer = ingest_job.dedupe_stream(stream).writeStream.format("parquet").trigger(**ONCE)
        return writer.option("checkpointLocation", f"{root}/checkpoint").start(f"{root}/out")

    streamed(slices(posts, "30 minutes", "30 minutes"), f"{root}/posts", start)
    return spark.read.schema(posts.schema).parquet(f"{root}/out")


def dedupe_history(spark, sf_dir):
    """Three slices, all of the first one sent again with each later one, ten and
    twenty days behind."""
    root = shared_folder(spark, "dedupe-history")
    posts = Inputs(spark, sf_dir).posts().select("id", "ticker", "timestamp", "source")

    def start(stream: DataFrame) -> StreamingQuery:
        writer = ingest_job.dedupe_stream(stream, None).writeStream.format("parquet").trigger(**ONCE)
        writer = writer.option("checkpointLocation", f"{root}/checkpoint")
        return with_rocks(spark, lambda: writer.start(f"{root}/out"))

    first, second, third = slices(posts, "0 days", "0 days")
    parts = iter((first, second.unionByName(first), third.unionByName(first)))
    streamed(parts, f"{root}/posts", start)
    return spark.read.schema(posts.schema).parquet(f"{root}/out")


def backtest_stream(spark, sf_dir):
    """Figures kept over three slices of bars, then over closes of one ticker that
    were wrong at first."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "backtest-stream")
    bars = inputs.bars("1h")
    signals = research.trading_signals(inputs.posts(), bars).select(*SIGNAL_ROW.names)
    wrong = signals.withColumn("close", F.when(F.col("ticker") == "click", F.col("close") + 1).otherwise(F.col("close")))
    kept = backtest_job.BacktestTables.at(f"{root}/tables")

    def start(stream: DataFrame) -> StreamingQuery:
        return backtest_job.start_backtests(stream, kept, f"{root}/checkpoint", ONCE, fold_every=2)

    parts = [*slices(wrong, "1 day", "0 days"), signals.filter("ticker = 'click'")]
    streamed(iter(parts), f"{root}/signals", start)
    return backtest.summary_view(kept.figures(spark))


def post_stream(spark, sf_dir):
    """Bus records in several files, through the stream source to valid posts."""
    root = shared_folder(spark, "bus")
    wire = Inputs(spark, sf_dir).wire()
    wire.select(F.col("value").cast("string")).repartition(4).write.text(f"{root}/records")
    records = post_source.read_post_stream(spark, "text", f"{root}/records", maxFilesPerTrigger=1)
    valid = post_source.valid_posts(records)
    (
        valid.writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**ONCE)
        .start(f"{root}/posts")
        .awaitTermination()
    )
    return spark.read.schema(valid.schema).parquet(f"{root}/posts")


def written_rows(spark, sf_dir):
    """Row counts that the writes of two batches report themselves."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "counted")
    counts = []
    for batch_id, rows in enumerate((inputs.posts(), inputs.resent_posts())):
        seen = Observation(f"batch {batch_id}")
        tables.write_batch(rows, root, batch_id, observation=seen)
        counts.append((batch_id, seen.get["rows"]))
    return spark.createDataFrame(counts, "batch_id int, rows long")


def alert_stream(spark, sf_dir):
    """Rolled bars in three batches, the second with a day of the first again,
    against the subscribed chats."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "alerts")
    aligned = asof.align_sentiment_with_price(inputs.posts(), inputs.bars("1h"))
    rolled = signals.add_rolling_sentiment(aligned, ("1h",))
    rolled = rolled.select("ticker", "timestamp", "sentiment_roll_1h")
    target = alert_job.AlertTables(f"{root}/log", f"{root}/last")

    def start(stream: DataFrame) -> StreamingQuery:
        return alert_job.start_alerts(
            stream, lambda: fixtures.subscriptions(inputs.events), target, f"{root}/checkpoint", ONCE
        )

    streamed(slices(rolled, "1 day", "0 days"), f"{root}/rolled", start)
    log = tables.read_batches(spark, target.log, ALERT)
    return log.select("chat_id", "ticker", "timestamp", "kind", "threshold")


def market_alerts(spark, sf_dir):
    """Raw posts and ticks in three slices, the job restarted for each, against
    all chats at their own windows."""
    inputs = Inputs(spark, sf_dir)
    root = shared_folder(spark, "market")
    chats = fixtures.subscriptions(inputs.events)
    rows = inputs.events.withColumn("timestamp", F.col("ts"))
    target = signal_job.SignalTables(f"{root}/log", f"{root}/late")

    def start(stream: DataFrame) -> StreamingQuery:
        events = stream.drop("timestamp")
        return signal_job.start_market_alerts(
            fixtures.posts(events), fixtures.ticks(events), lambda: chats, target, f"{root}/checkpoint", ONCE
        )

    streamed(slices(rows, "0 days", "0 days"), f"{root}/events", start)
    log = tables.read_batches(spark, target.log, ALERT)
    return log.select("chat_id", "ticker", "timestamp", "kind", "threshold")


def out_of_order(rows: DataFrame, parts: int) -> Iterator[DataFrame]:
    """All rows in ``parts`` batches by a hash of their time, so that every batch has
    rows from all over the table and most come long after later ones."""
    part = F.pmod(F.xxhash64("timestamp"), F.lit(parts))
    for number in range(parts):
        yield rows.filter(part == number)


def live_buckets(spark, sf_dir):
    """Buckets of posts that arrive in no order, kept by a stream and folded."""
    root = shared_folder(spark, "live-buckets")
    table = market.bucket_part_table(f"{root}/table")

    def start(stream: DataFrame) -> StreamingQuery:
        return market.start_live_buckets(stream, table, f"{root}/checkpoint", trigger=ONCE, fold_every=2)

    streamed(out_of_order(Inputs(spark, sf_dir).posts(), 4), f"{root}/posts", start)
    return rounded(market.buckets_of(table.current(spark)))


def live_bars(spark, sf_dir):
    """Bars of ticks in three slices, a part of each one late by a slice."""
    root = shared_folder(spark, "live-bars")
    table = market.bar_part_table(f"{root}/table")
    ticks = fixtures.ticks(Inputs(spark, sf_dir).events)

    def start(stream: DataFrame) -> StreamingQuery:
        return market.start_live_bars(stream, table, "15m", f"{root}/checkpoint", ONCE, fold_every=2)

    late = F.pmod(F.xxhash64("tick_id"), F.lit(5)) == 0
    first, second, third = slices(ticks, "0 days", "0 days")
    parts = [first.filter(~late), second.filter(~late).unionByName(first.filter(late))]
    parts.append(third.unionByName(second.filter(late)))
    streamed(iter(parts), f"{root}/ticks", start)
    return rounded(market.bars_of(table.current(spark)))


def live_table(spark, sf_dir):
    """Posts in ten batches of two feeds, the later feed with posts sent again, and
    folded three times while they come."""
    inputs = Inputs(spark, sf_dir)
    spark_rows = inputs.posts().select(*STORED_SCORE.names)
    again = inputs.resent_posts().select(*STORED_SCORE.names)
    table = live.keyed_table(shared_folder(spark, "live"), STORED_SCORE, tables.POST_KEY, ("first", "second"))
    for batch_id, rows in enumerate(out_of_order(spark_rows, 5)):
        table.take(rows, batch_id, "first", fold_every=2)
    for batch_id, rows in enumerate(out_of_order(again, 5)):
        table.write(rows.limit(0), batch_id, "second")  # an attempt that failed half way
        table.take(rows, batch_id, "second", fold_every=3)
    return rounded(table.current(spark))


def entry(spark: SparkSession) -> DataFrame:
    return signal_frame("1h", "1h")(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        "parse_posts": parse_posts,
        "validate_posts": validate_posts,
        "rejected_posts": rejected_posts,
        "serialize_posts": serialize_posts,
        "posts_by_date": posts_by_date,
        "dedupe_posts": dedupe_posts,
        "upsert_posts": upsert_posts,
        "label_posts": label_posts,
        "normalize_ticker": normalize_ticker,
        "tickers": tickers,
        "recent_posts": recent_posts,
        "recent_posts_one_ticker": recent_posts_one_ticker,
        "post_feed": post_feed,
        "score_posts": score_posts,
        "score_posts_udf": score_posts_udf,
        "ohlcv_15m": ohlcv("15m"),
        "ohlcv_1h": ohlcv("1h"),
        "ohlcv_1d": ohlcv("1d"),
        "normalize_bars": normalize_bars,
        "rejected_bars": rejected_bars,
        "upsert_bars": upsert_bars,
        "bar_spacing": bar_spacing("event_type"),
        "bar_spacing_users": bar_spacing("user_id"),
        "sentiment_15m": buckets("15m"),
        "sentiment_1h": buckets("1h"),
        "sentiment_24h": buckets("24h"),
        "asof_align": asof_align("15m"),
        "asof_align_users": asof_align("1h", "user_id"),
        "rolling_sentiment": rolling_sentiment,
        "signals": signals_15m,
        "signal_frame": signal_frame("1h", "1h"),
        "signal_frame_15m": signal_frame("15m", "15m"),
        "signal_frame_24h": signal_frame("1d", "24h"),
        "signal_frame_users": signal_frame("1h", "4h", "user_id"),
        "asof_stored": asof_stored,
        "signal_frame_stored": signal_frame_stored,
        "latest_signal": latest_signal,
        "chart_series": chart_series,
        "equity_curve": equity_curve,
        "benchmark_curve": benchmark_curve,
        "drawdown": drawdown,
        "returns_series": returns_series,
        "backtest_summary": backtest_summary("1h", "1h"),
        "backtest_summary_15m": backtest_summary("15m", "15m"),
        "backtest_summary_users": backtest_summary("1h", "1h", "user_id"),
        "alerts": alerts,
        "alerts_new": alerts_new,
        "alert_history": alert_history,
        "stored_posts": stored_posts,
        "compacted_posts": compacted_posts,
        "ingest_stream": ingest_stream,
        "bucket_stream": bucket_stream,
        "bucket_table": bucket_table,
        "dedupe_stream": dedupe_stream,
        "post_stream": post_stream,
        "written_rows": written_rows,
        "alert_stream": alert_stream,
        "market_alerts": market_alerts,
        "dedupe_history": dedupe_history,
        "backtest_stream": backtest_stream,
        "live_buckets": live_buckets,
        "live_bars": live_bars,
        "live_table": live_table,
        **({**llm.QUERIES, "pipeline": corpus_pipeline.run} if llm else {}),
    }


def oracle_sql() -> dict[str, str]:
    return {**oracle.statements(), **(llm.ORACLE_SQL if llm else {})}
