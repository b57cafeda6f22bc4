"""Dates and time strings are meant in UTC."""

from pyspark.sql import SparkSession

# Names of that zone.
UTC_NAMES = ("UTC", "Etc/UTC", "Z", "+00:00", "GMT", "Etc/GMT")


def utc_session(spark: SparkSession) -> None:
    """Refuses a session whose dates and time strings would be those of another
    zone: a post near midnight would land in another partition without a word."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in UTC_NAMES:
        raise ValueError(f"set spark.sql.session.timeZone to UTC, it is {zone}")
