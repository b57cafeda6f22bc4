"""Posts on the wire: parse, validate, serialize."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitflow.functions.utc import utc_session
from pitflow.schemas import RAW_FIELDS, WIRE_POST


ISO = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"


def read_post_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, **options) -> DataFrame:
    """A stream of bus records with a ``value`` column. Kafka starts at the
    latest offsets and goes on after data loss, unless options say otherwise."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "false", **options}
    elif fmt not in ("text", "rate"):
        reader = reader.schema("key binary, value binary")
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def _parsed(records: DataFrame) -> DataFrame:
    """Wire fields next to the text they came from, the timestamp both as sent
    and as parsed. Malformed JSON gives nulls, it does not raise; nor does a
    timestamp that is no ISO date and time. A time alone is none: it would mean
    another day on each replay."""
    utc_session(records.sparkSession)
    parsed = records.select(F.col("value").cast("string").alias("value")).select(
        "value", F.inline(F.array(F.from_json("value", WIRE_POST)))
    )
    return parsed.withColumn("sent", F.col("timestamp")).withColumn(
        "timestamp", F.when(F.col("timestamp").rlike(ISO), F.try_to_timestamp("timestamp"))
    )


def parse_posts(records: DataFrame) -> DataFrame:
    return _parsed(records).select(*RAW_FIELDS)


def _reject_reason() -> Column:
    fields = [F.col("id"), F.col("ticker"), F.col("sent"), F.col("source"), F.col("text")]
    nothing = fields[0].isNull()
    for field in fields[1:]:
        nothing = nothing & field.isNull()
    reason = F.when(nothing, "malformed")
    for name, field in zip(RAW_FIELDS, fields):
        blank = field.isNull()
        if name in ("id", "ticker"):  # keys: a blank one would read back as null
            blank = blank | (F.trim(field) == "")
        reason = reason.when(blank, f"missing {name}")
    return reason.when(F.col("timestamp").isNull(), "bad timestamp")


def with_reject_reason(records: DataFrame) -> DataFrame:
    """Parsed fields plus ``value`` and ``reason``; a good post has no reason."""
    return _parsed(records).withColumn("reason", _reject_reason()).drop("sent")


def valid_posts(records: DataFrame) -> DataFrame:
    """Posts with all five fields."""
    return with_reject_reason(records).filter("reason is null").select(*RAW_FIELDS)


def rejected_posts(records: DataFrame) -> DataFrame:
    return with_reject_reason(records).filter("reason is not null").select("value", "reason")


def serialize_posts(posts: DataFrame) -> DataFrame:
    """Bus records: ticker bytes as key, the row as JSON as value."""
    return posts.select(
        F.col("ticker").cast("binary").alias("key"),
        F.to_json(F.struct(*posts.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
        .cast("binary")
        .alias("value"),
    )


def with_date(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    utc_session(df.sparkSession)
    return df.withColumn("date", F.to_date(timestamp))
