"""Price bars: normalized from files, or resampled from ticks."""

from collections.abc import Sequence
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitflow.functions.cells import CELL, DEFAULT_CELL, US, in_cell, over_cells, placed, with_cells
from pitflow.functions.durations import bucket_us, duration_us, interval_sql
from pitflow.operators.keyed import latest_per_key
from pitflow.operators.median import weighted_median
from pitflow.schemas import BAR

# Names providers use for the two key columns.
KEY_ALIASES = {"date": "timestamp", "datetime": "timestamp", "symbol": "ticker"}


def bar_columns(raw: DataFrame) -> DataFrame:
    """Any provider's column names as the bar columns, in order and typed."""
    names = {}
    for name in raw.columns:
        names.setdefault(KEY_ALIASES.get(name.lower(), name.lower()), name)
    missing = [f.name for f in BAR.fields if f.name not in names]
    if missing:
        raise ValueError(f"bars lack {missing}")
    types = dict(raw.dtypes)

    def typed(field) -> Column:
        source = F.col(f"`{names[field.name]}`")
        if field.name == "timestamp" and types[names["timestamp"]] == "string":
            return F.try_to_timestamp(source).alias(field.name)
        return source.cast(field.dataType).alias(field.name)

    return raw.select(*[typed(f) for f in BAR.fields])


def _usable() -> Column:
    placed_row = F.col("ticker").isNotNull() & F.col("timestamp").isNotNull()
    return placed_row & F.coalesce((F.col("close") > 0) & ~F.isnan("close"), F.lit(False))


def _too_late(as_of: datetime | Column | None) -> Column:
    return F.lit(False) if as_of is None else F.col("timestamp") > F.lit(as_of)


def rejected_bars(raw: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    """Bars without key or without a positive close, and those after ``as_of``."""
    return bar_columns(raw).filter(~_usable() | F.coalesce(_too_late(as_of), F.lit(False)))


def normalize_bars(
    raw: DataFrame,
    tickers: Sequence[str] | None = None,
    lookback: str | None = None,
    as_of: datetime | Column | None = None,
    order: Sequence[str] = ("volume", "close", "open", "high", "low"),
) -> DataFrame:
    """Usable bars of the wanted tickers, one per (ticker, timestamp). Tickers
    without bars just do not appear.

    ``as_of`` leaves out bars of later times, ``lookback`` those longer ago than
    that; it needs an ``as_of``, as a wrong stamp on one bar must not move the
    range of all others."""
    if lookback is not None and as_of is None:
        raise ValueError("lookback needs as_of")
    bars = bar_columns(raw).filter(_usable() & ~_too_late(as_of))
    if tickers is not None:
        bars = bars.filter(F.col("ticker").isin(list(tickers)))
    if lookback is not None:
        reach = F.expr(f"interval {interval_sql(duration_us(lookback))}")
        bars = bars.filter(F.col("timestamp") >= F.lit(as_of) - reach)
    return latest_per_key(bars, ["ticker", "timestamp"], [F.col(c).desc() for c in order])


def tick_order() -> Column:
    """Time, then tick_id, as one number. Unlike a pair it fits the fixed-width
    buffers of hash aggregation, so ticks are not sorted to be aggregated."""
    us = F.unix_micros("timestamp").cast("decimal(18,0)")
    step = F.lit(Decimal(2 * 10**19))  # above the range of tick ids
    return (us * step + F.col("tick_id").cast("decimal(19,0)")).cast("decimal(38,0)")


def resample(ticks: DataFrame, interval: str) -> DataFrame:
    """OHLCV bars from ticks (ticker, timestamp, tick_id, price, size), stamped
    at the window's start; tick_id is a whole number. Ticks combine before the
    shuffle."""
    return (
        placed(ticks)
        .groupBy("ticker", F.window("timestamp", interval_sql(bucket_us(interval))).alias("window"))
        .agg(
            F.min_by("price", tick_order()).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", tick_order()).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(
            "ticker",
            F.col("window.start").alias("timestamp"),
            "open",
            "high",
            "low",
            "close",
            "volume",
        )
    )


def bar_spacing(bars: DataFrame, cell: str = DEFAULT_CELL) -> DataFrame:
    """Median distance between neighbouring bars of each ticker.

    Distances are counted per (ticker, distance) first, and the median is found by
    radix selection: on a regular grid there is one distance, and on an irregular
    one no task puts those of a ticker in order.
    """
    rows = with_cells(bars.select("ticker", "timestamp"), cell)
    inside = rows.withColumn("gap", F.col(US) - F.lag(US).over(in_cell())).select("ticker", "gap")
    edges = (
        rows.groupBy("ticker", CELL)
        .agg(F.min(US).alias("_first"), F.max(US).alias("_last"))
        .withColumn("gap", F.col("_first") - F.lag("_last").over(over_cells()))
        .select("ticker", "gap")
    )
    counted = inside.unionByName(edges).filter("gap is not null").groupBy("ticker", "gap").count()

    return weighted_median(counted, ["ticker"], "gap", "count", "spacing_us")
