"""Labels, ticker names and feed text as native columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pitflow.schemas import FEED_TEXT_LENGTH, LABEL_THRESHOLD

# The five characters HTML needs escaped, ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
)


def sentiment_label(score: Column, threshold: float = LABEL_THRESHOLD) -> Column:
    return (
        F.when(score > threshold, "positive")
        .when(score < -threshold, "negative")
        .otherwise("neutral")
    )


def direction(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit(0.0)) >= 0, "up").otherwise("down")


def ticker_symbol(raw: Column) -> Column:
    return F.regexp_replace(F.upper(raw), r"^\$+", "")


def html_escape(text: Column) -> Column:
    for plain, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def feed_text(text: Column, length: int = FEED_TEXT_LENGTH) -> Column:
    """Escaped first and cut afterwards, so the cut counts escaped characters."""
    return F.substring(html_escape(text), 1, length)


def feed_time(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd HH:mm 'UTC'")


def not_nan(value: Column) -> Column:
    """Spark averages NaN in; a missing score must be null instead."""
    return F.when(F.isnan(value), None).otherwise(value)
