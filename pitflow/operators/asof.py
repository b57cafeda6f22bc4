"""Strict backward as-of join of bars onto sentiment buckets."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitflow.functions.cells import (
    CELL,
    DEFAULT_CELL,
    US,
    before_cell,
    cell_start,
    in_cell,
    is_home,
    leave_cells,
    placed,
    with_cells,
)
from pitflow.functions.durations import duration_us
from pitflow.operators.sentiment import aggregate_sentiment
from pitflow.schemas import (
    BARS_FIRST,
    BUCKET_COLUMNS,
    BUCKET_STRUCT,
    BUCKET_WINDOW,
    BUCKETS_SECOND,
    SIDE,
)



def align_in_cells(
    bars: DataFrame, buckets: DataFrame, cell: str = DEFAULT_CELL, overlap_us: int = 0
) -> DataFrame:
    """The as-of join, leaving the cell columns (and overlap copies) in place
    so that later steps can use the same shuffle.

    Both sides meet in one union, hashed by (ticker, cell), and the last bucket
    before each bar is a running ``last``. Bars sort before buckets at the same
    instant, which makes the match strict. The bucket travels as one struct, so
    a null inside it stays null instead of falling back to an older bucket.

    A bucket that no later cell holds is still visible there. For each cell
    with bars, the newest such bucket is added as one more input row.
    """
    width = duration_us(cell)
    present = [c for c in BUCKET_COLUMNS if c in buckets.columns]
    packed = placed(buckets).select("ticker", "timestamp", F.struct(*present).alias(BUCKET_STRUCT))
    packed_type = packed.schema[BUCKET_STRUCT].dataType

    bar_rows = (
        with_cells(bars, cell, overlap_us)
        .withColumn(SIDE, F.lit(BARS_FIRST))
        .withColumn(BUCKET_STRUCT, F.lit(None).cast(packed_type))
    )
    bucket_rows = with_cells(packed, cell, overlap_us).withColumn(SIDE, F.lit(BUCKETS_SECOND))
    carried_rows = _carried_buckets(bars, packed, cell, width, overlap_us).withColumn(
        SIDE, F.lit(BUCKETS_SECOND)
    )

    so_far = in_cell(SIDE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = (
        bar_rows.unionByName(bucket_rows, allowMissingColumns=True)
        .unionByName(carried_rows, allowMissingColumns=True)
        .withColumn(BUCKET_STRUCT, F.last(BUCKET_STRUCT, ignorenulls=True).over(so_far))
        .filter(F.col(SIDE) == BARS_FIRST)
    )
    return _unpacked(matched, present).drop(SIDE)


def _unpacked(matched: DataFrame, present: Sequence[str]) -> DataFrame:
    for name in present:
        value = F.col(f"{BUCKET_STRUCT}.{name}")
        if name == "avg_sentiment":
            value = F.coalesce(value, F.lit(0.0))
        elif name == "post_count":
            value = F.coalesce(value, F.lit(0).cast("long"))
        matched = matched.withColumn(name, value)
    return matched.drop(BUCKET_STRUCT)


def _carried_buckets(
    bars: DataFrame, packed: DataFrame, cell: str, width: int, overlap_us: int
) -> DataFrame:
    bar_cells = (
        with_cells(bars.select("ticker", "timestamp"), cell, overlap_us)
        .select("ticker", CELL)
        .distinct()
        .withColumn("_kind", F.lit(1))
    )
    # The first cell that holds no copy of the bucket itself.
    us = F.unix_micros("timestamp")
    newest = (
        packed.withColumn(US, us)
        .withColumn(CELL, cell_start(F.col(US) + F.lit(overlap_us), width) + F.lit(width))
        .groupBy("ticker", CELL)
        .agg(F.max_by(F.struct(US, BUCKET_STRUCT), F.col(US)).alias("_newest"))
        .withColumn("_kind", F.lit(0))
    )
    earlier = (
        Window.partitionBy("ticker")
        .orderBy(CELL, "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        bar_cells.unionByName(newest, allowMissingColumns=True)
        .withColumn("_newest", F.last("_newest", ignorenulls=True).over(earlier))
        .filter(F.expr(f"_kind = 1 and _newest is not null and {CELL} is not null"))
        .select("ticker", CELL, f"_newest.{US}", f"_newest.{BUCKET_STRUCT}")
    )


def align_stored(rows: DataFrame, cell: str = DEFAULT_CELL, overlap_us: int = 0) -> DataFrame:
    """``align_in_cells`` of bars and buckets that one table holds (``SERIES_ROW``), in
    cells and with their overlap copies. Where that table is stored by (ticker, cell)
    neither is shuffled: buckets of earlier cells come in by a join with one row per
    (ticker, cell).

    A bucket without a copy in a cell is older than every row of that cell, so
    it is what bars get that found none inside."""
    is_bar = F.col(SIDE) == BARS_FIRST
    last_copy = F.col(CELL) == cell_start(F.col(US) + F.lit(overlap_us), duration_us(cell))
    leaves = (F.col(SIDE) == BUCKETS_SECOND) & last_copy
    carried = (
        rows.groupBy("ticker", CELL)
        .agg(
            F.max_by(F.when(leaves, F.col(BUCKET_STRUCT)), F.when(leaves, F.col(US))).alias("_newest"),
            F.bool_or(is_bar).alias("_has_bars"),
        )
        .withColumn("_newest", F.last("_newest", ignorenulls=True).over(before_cell()))
        .filter("_has_bars and _newest is not null")
        .select("ticker", CELL, "_newest")
    )
    so_far = in_cell(SIDE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = (
        rows.withColumn(BUCKET_STRUCT, F.last(BUCKET_STRUCT, ignorenulls=True).over(so_far))
        .filter(is_bar)
        .join(carried, ["ticker", CELL], "left")
        .withColumn(BUCKET_STRUCT, F.coalesce(BUCKET_STRUCT, "_newest"))
        .drop(SIDE, "_newest")
    )
    return _unpacked(matched, BUCKET_COLUMNS)


def asof_align(bars: DataFrame, buckets: DataFrame, cell: str = DEFAULT_CELL) -> DataFrame:
    """Each bar with the last bucket stamped strictly before it, however old.
    Bars without one get sentiment 0.0, count 0 and null class means."""
    return leave_cells(align_in_cells(bars, buckets, cell))


def align_sentiment_with_price(
    scored: DataFrame,
    bars: DataFrame,
    window: str = BUCKET_WINDOW,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    return asof_align(bars, aggregate_sentiment(scored, window), cell)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_home(CELL))
