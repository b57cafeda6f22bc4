"""Row types and parameter defaults."""

from pyspark.sql import types as T

# Field names, windows, thresholds and fees users already rely on.
SOURCES = ("reddit", "news", "twitter")
SCORING_BATCH = 32
BUCKET_WINDOW = "15m"
ROLLING_WINDOWS = ("15m", "1h", "4h", "24h")
SIGNAL_WINDOW = "1h"
BAR_INTERVALS = {"15m": "15m", "1h": "1h", "4h": "1h", "24h": "1d"}
ENTRY_THRESHOLD = 0.4
EXIT_THRESHOLD = -0.2
LABEL_THRESHOLD = 0.2
INITIAL_CASH = 100_000.0
FEE = 0.001
RECENT_POSTS = 50
FEED_POSTS = 10
FEED_TEXT_LENGTH = 200
TRIGGER = "30 seconds"
ALERT_TRIGGER = "60 seconds"
WATERMARK = "1 hour"

RAW_FIELDS = ("id", "ticker", "timestamp", "source", "text")

# On the wire a post is JSON whose five fields are all strings.
WIRE_POST = T.StructType([T.StructField(name, T.StringType()) for name in RAW_FIELDS])

RAW_POST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

SCORE_FIELDS = T.StructType(
    [
        T.StructField("positive", T.DoubleType()),
        T.StructField("neutral", T.DoubleType()),
        T.StructField("negative", T.DoubleType()),
        T.StructField("sentiment_score", T.DoubleType()),
    ]
)

SCORED_POST = T.StructType(RAW_POST.fields + SCORE_FIELDS.fields)

#: What a scored post is known by once its text is stored elsewhere.
STORED_SCORE = T.StructType(
    [f for f in RAW_POST.fields if f.name in ("id", "ticker", "timestamp")]
    + [f for f in SCORE_FIELDS.fields if f.name == "sentiment_score"]
)

REJECTED_POST = T.StructType(
    [T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())]
)

BAR = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.DoubleType()),
    ]
)

BUCKET = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("avg_sentiment", T.DoubleType()),
        T.StructField("post_count", T.LongType()),
        T.StructField("avg_positive", T.DoubleType()),
        T.StructField("avg_negative", T.DoubleType()),
    ]
)

BUCKET_COLUMNS = ("avg_sentiment", "post_count", "avg_positive", "avg_negative")

#: Bars sort before buckets of the same instant.
SIDE = "_side"
BARS_FIRST, BUCKETS_SECOND = 0, 1
BUCKET_STRUCT = "_bucket"
#: Bars and buckets in one table; each row is one of both, the rest is null.
SERIES_ROW = T.StructType(
    [*BAR.fields, T.StructField(SIDE, T.IntegerType())]
    + [T.StructField(BUCKET_STRUCT, T.StructType([f for f in BUCKET.fields if f.name in BUCKET_COLUMNS]))]
)

SUBSCRIPTION = T.StructType(
    [
        T.StructField("chat_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("window", T.StringType()),
        T.StructField("subscribed", T.BooleanType()),
        T.StructField("subscribed_at", T.TimestampType()),
    ]
)

ALERT = T.StructType(
    [
        T.StructField("chat_id", T.LongType()),
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
    ]
)

#: A bar's signals as stored; what a backtest reads.
SIGNAL_ROW = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("entry_signal", T.BooleanType()),
        T.StructField("exit_signal", T.BooleanType()),
    ]
)

_GAP = T.StructType([T.StructField("gap", T.LongType()), T.StructField("n", T.LongType())])
#: One stored cell of a backtest. The names that end in 0 hold if it starts flat, in 1 if long.
CELL_SUMMARY = T.StructType(
    [
        T.StructField("ticker", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("n", T.LongType()),
        T.StructField("last_event", T.IntegerType()),
        T.StructField("first_us", T.LongType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("gaps", T.ArrayType(_GAP)),
    ]
    + [T.StructField(n, T.DoubleType()) for n in ("first_close", "last_close", "hold1", "hold2")]
    + [
        T.StructField(f"{part}{start}", T.DoubleType())
        for start in (0, 1)
        for part in ("total", "high", "low", "fall", "first", "gain1", "gain2")
    ]
)
