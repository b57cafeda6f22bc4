"""Rolling sentiment and threshold-crossing signals."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.functions.cells import (
    CELL,
    DEFAULT_CELL,
    US,
    in_cell,
    is_home,
    leave_cells,
    over_cells,
    with_cells,
)
from pitflow.functions.durations import duration_us
from pitflow.operators.asof import align_in_cells, home_rows
from pitflow.schemas import (
    ENTRY_THRESHOLD,
    EXIT_THRESHOLD,
    ROLLING_WINDOWS,
    SIGNAL_WINDOW,
)

# Sums of decimals do not depend on the order of addition, so the result is the
# same for every cell width, and a mean that is exactly a threshold stays so.
# Scores lie in [-1, 1]; 18 digits are what Spark still adds as longs.
_EXACT = "decimal(18,15)"


def roll_column(label: str) -> str:
    return f"sentiment_roll_{label}"


def widest_us(windows: Sequence[str]) -> int:
    return max(duration_us(w) for w in windows)


def exact_value(name: str) -> Column:
    """Exact to 15 places. A value of 1000 or more is no score and counts as missing."""
    return F.col(name).try_cast(_EXACT)


def exact_mean(total: Column, count: Column) -> Column:
    return F.try_divide(total, count).cast("double")


def roll_in_cells(df: DataFrame, windows: Sequence[str], value: str = "avg_sentiment") -> DataFrame:
    """Trailing means over (t - w, t]; rows in front of a cell must be there as
    overlap copies.

    Each mean is the running total up to t minus the running total up to t - w.
    Both frames only grow, so Spark visits every row once per window length; a
    frame with two moving ends would add up the whole window again for each row.
    """
    exact = exact_value(value)
    upto_now = in_cell().rangeBetween(Window.unboundedPreceding, Window.currentRow)
    means = {}
    for label in windows:
        before = in_cell().rangeBetween(Window.unboundedPreceding, -duration_us(label))
        total = F.sum(exact).over(upto_now) - F.coalesce(F.sum(exact).over(before), F.lit(0))
        count = F.count(exact).over(upto_now) - F.count(exact).over(before)
        means[roll_column(label)] = exact_mean(total, count)
    return df.withColumns(means)


def add_rolling_sentiment(
    aligned: DataFrame, windows: Sequence[str] = ROLLING_WINDOWS, cell: str = DEFAULT_CELL
) -> DataFrame:
    """One ``sentiment_roll_<label>`` column per window, at least one row each."""
    spread = with_cells(aligned, cell, widest_us(windows))
    return leave_cells(home_rows(roll_in_cells(spread, windows)))


def last_values(df: DataFrame, roll: str) -> DataFrame:
    """``_value``, the rolling value on the last row of each (ticker, cell)."""
    return (
        df.groupBy("ticker", CELL)
        .agg(F.max_by(F.struct(*df.columns), F.col(US)).alias("_last"))
        .select("ticker", CELL, F.col(f"_last.{roll}").alias("_value"))
    )


def last_values_of_aligned(aligned: DataFrame, label: str, value: str = "avg_sentiment") -> DataFrame:
    """The same from rows that have no rolling column yet: one mean over the
    end of each cell is much less work than rolling over all of it.

    The last row is taken whole, and looked at, so that this branch asks for
    the same columns as the one with the bars and reads the same shuffle.
    """
    whole_cell = Window.partitionBy("ticker", CELL)
    end = F.max(F.when(is_home(CELL), F.col(US))).over(whole_cell)
    return (
        aligned.withColumn("_end", end)
        .filter((F.col(US) > F.col("_end") - duration_us(label)) & (F.col(US) <= F.col("_end")))
        .groupBy("ticker", CELL)
        .agg(
            F.max_by(F.struct(*aligned.columns), F.col(US)).alias("_last"),
            exact_mean(F.sum(exact_value(value)), F.count(exact_value(value))).alias("_mean"),
        )
        .select("ticker", CELL, F.when(F.col("_last").isNotNull(), F.col("_mean")).alias("_value"))
    )


def with_previous(df: DataFrame, roll: str, last: DataFrame) -> DataFrame:
    """Adds ``_before``, the rolling value on the ticker's previous row (null on
    its first), for rows without overlap copies.

    Inside a cell that is a plain ``lag``. The first row of a cell gets the last
    value of the ticker's previous non-empty cell, one carry row per cell.
    """
    carry = last.select(
        "ticker", CELL, F.lag("_value").over(over_cells()).alias("_carry")
    )
    inside = F.lag(F.struct(roll)).over(in_cell())
    return (
        df.withColumn("_inside", inside)
        .join(carry, ["ticker", CELL], "left")
        .withColumn(
            "_before",
            F.when(F.col("_inside").isNull(), F.col("_carry")).otherwise(F.col(f"_inside.{roll}")),
        )
        .drop("_inside", "_carry")
    )


def crossing(now: Column, before: Column, entry: float, exit_: float) -> tuple[Column, Column]:
    up = (now > entry) & (before <= entry)
    down = (now < exit_) & (before >= exit_)
    return F.coalesce(up, F.lit(False)), F.coalesce(down, F.lit(False))


def signals_in_cells(
    df: DataFrame, label: str, entry: float, exit_: float, last: DataFrame
) -> DataFrame:
    roll = roll_column(label)
    df = with_previous(df, roll, last)
    up, down = crossing(F.col(roll), F.col("_before"), entry, exit_)
    return df.withColumn("entry_signal", up).withColumn("exit_signal", down).drop("_before")


def generate_signals(
    df: DataFrame,
    label: str = SIGNAL_WINDOW,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    """Boolean entry and exit columns, true on the bar where the rolling mean
    crosses its threshold and false on every other bar."""
    if roll_column(label) not in df.columns:
        raise ValueError(f"missing column {roll_column(label)!r}; add rolling sentiment first")
    spread = with_cells(df, cell)
    last = last_values(spread, roll_column(label))
    return leave_cells(signals_in_cells(spread, label, entry_threshold, exit_threshold, last))


def build_signal_frame(
    aligned: DataFrame,
    label: str = SIGNAL_WINDOW,
    windows: Sequence[str] = ROLLING_WINDOWS,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    spread = with_cells(aligned, cell, widest_us(windows))
    rolled = home_rows(roll_in_cells(spread, windows))
    last = last_values_of_aligned(spread, label)
    return leave_cells(signals_in_cells(rolled, label, entry_threshold, exit_threshold, last))


def signal_frame_in_cells(
    bars: DataFrame,
    buckets: DataFrame,
    label: str = SIGNAL_WINDOW,
    windows: Sequence[str] = ROLLING_WINDOWS,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    """As-of join, rolling means and signals over a single shuffle of the bars."""
    aligned = align_in_cells(bars, buckets, cell, widest_us(windows))
    return signals_of_aligned(aligned, label, windows, entry_threshold, exit_threshold)


def signals_of_aligned(
    aligned: DataFrame,
    label: str = SIGNAL_WINDOW,
    windows: Sequence[str] = ROLLING_WINDOWS,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
) -> DataFrame:
    """Rolling means and signals of aligned rows in cells, with overlap copies for
    the widest window."""
    rolled = home_rows(roll_in_cells(aligned, windows))
    last = last_values_of_aligned(aligned, label)
    return signals_in_cells(rolled, label, entry_threshold, exit_threshold, last)
