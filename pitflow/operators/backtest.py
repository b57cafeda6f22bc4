"""Long-only backtest of entry and exit signals against buy and hold.

The position starts flat. An entry while flat buys with all cash at that bar's
close, an exit while long sells everything at the close, both with the fee;
other signals, and an entry together with an exit, change nothing. An open
position is valued at the last close. The benchmark buys at the first close
and pays no fee.

Everything is a sum of logs, so long runs do not overflow, and every step
composes over time cells. The one thing a cell does not know is whether it
starts flat or long; it is worked out for both, and the pass over the cells
then picks one.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.functions.cells import (
    CELL,
    DEFAULT_CELL,
    US,
    before_cell,
    in_cell,
    over_cells,
    with_cells,
)
from pitflow.functions.durations import DAY_US
from pitflow.operators.median import weighted_median
from pitflow.schemas import CELL_SUMMARY, FEE, INITIAL_CASH
from pitflow.sources.bars import bar_spacing

FLAT, LONG = 0, 1
YEAR_US = 365 * DAY_US
MIN_BARS = 3


def _rows(signals: DataFrame, fee: float, cell: str) -> DataFrame:
    """Per bar and per assumed start: log step, its running sum, running peak."""
    # Signals that come with their cells keep them, and so their partitioning.
    placed = signals if {CELL, US} <= set(signals.columns) else with_cells(signals, cell)
    entry = F.coalesce("entry_signal", F.lit(False))
    exit_ = F.coalesce("exit_signal", F.lit(False))
    event = F.when(entry & ~exit_, LONG).when(exit_ & ~entry, FLAT)
    upto = in_cell().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = in_cell().rowsBetween(Window.unboundedPreceding, -1)

    rows = placed.filter(F.col("close") > 0).select("ticker", "close", event.alias("_event"), CELL, US)
    rows = rows.withColumns(
        {
            "_now": F.last("_event", ignorenulls=True).over(upto),
            "_was": F.last("_event", ignorenulls=True).over(before),
            "_close_was": F.lag("close").over(in_cell()),
        }
    )
    rows = rows.withColumn("_move", F.coalesce(F.ln(F.col("close") / F.col("_close_was")), F.lit(0.0)))

    def step(start: int) -> Column:
        now = F.coalesce("_now", F.lit(start))
        was = F.coalesce("_was", F.lit(start))
        traded = (
            F.when(now > was, -F.log1p(F.lit(fee))).when(now < was, F.log1p(F.lit(-fee))).otherwise(0.0)
        )
        return F.when(was == LONG, F.col("_move")).otherwise(0.0) + traded

    starts = (FLAT, LONG)
    rows = rows.withColumns({f"_step{s}": step(s) for s in starts})
    rows = rows.withColumns({f"_path{s}": F.sum(f"_step{s}").over(upto) for s in starts})
    return rows.withColumns({f"_peak{s}": F.max(f"_path{s}").over(upto) for s in starts})


#: What a cell adds, for both of its possible starts.
PARTS = ("total", "high", "low", "fall", "first", "gain1", "gain2")


def _summaries(rows: DataFrame) -> DataFrame:
    """One row per (ticker, cell): all that the figures need of its bars. It depends
    on no other cell, so it can be stored, and replaced when its bars change.

    A cell's first bar also moves from the last close of the cell before, which
    only counts when the position was long."""
    not_first = F.col("_close_was").isNotNull()

    def inner_sum(step: Column, power: int = 1) -> Column:
        gain = F.expm1(step)
        return F.sum(F.when(not_first, gain * gain if power == 2 else gain).otherwise(0.0))

    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.min_by("close", F.col(US)).alias("first_close"),
        F.max_by("close", F.col(US)).alias("last_close"),
        F.max_by("_now", F.col(US)).alias("last_event"),
        inner_sum(F.col("_move")).alias("hold1"),
        inner_sum(F.col("_move"), 2).alias("hold2"),
    ]
    for s in (FLAT, LONG):
        step, path = F.col(f"_step{s}"), F.col(f"_path{s}")
        aggregates += [
            F.max_by(path, F.col(US)).alias(f"total{s}"),
            F.max(path).alias(f"high{s}"),
            F.min(path).alias(f"low{s}"),
            F.min(path - F.col(f"_peak{s}")).alias(f"fall{s}"),
            F.min_by(step, F.col(US)).alias(f"first{s}"),
            inner_sum(step).alias(f"gain1{s}"),
            inner_sum(step, 2).alias(f"gain2{s}"),
        ]
    return rows.groupBy("ticker", CELL).agg(*aggregates)


def _cells(cells: DataFrame) -> DataFrame:
    """The summaries resolved: how each cell starts and what it adds."""
    cells = cells.withColumns(
        {
            "start": F.coalesce(F.last("last_event", ignorenulls=True).over(before_cell()), F.lit(FLAT)),
            "gap": F.coalesce(
                F.ln(F.col("first_close") / F.lag("last_close").over(over_cells())), F.lit(0.0)
            ),
            "ticker_close": F.first("first_close").over(
                over_cells().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        }
    )
    is_long = F.col("start") == LONG
    cells = cells.withColumns(
        {p: F.when(is_long, F.col(f"{p}{LONG}")).otherwise(F.col(f"{p}{FLAT}")) for p in PARTS}
    ).withColumn("shift", F.when(is_long, F.col("gap")).otherwise(0.0))
    cells = cells.withColumn("added", F.col("total") + F.col("shift"))
    cells = cells.withColumn(
        "base", F.coalesce(F.sum("added").over(before_cell()), F.lit(0.0)) + F.col("shift")
    )
    # The peak starts at the initial cash, log 0.
    earlier_peak = F.max(F.col("base") + F.col("high")).over(before_cell())
    return cells.withColumn("peak", F.greatest(F.lit(0.0), earlier_peak))


def equity_curve(
    signals: DataFrame,
    cash: float = INITIAL_CASH,
    fee: float = FEE,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    """Per bar: position after the bar, value, both cumulative returns and the
    fall from the highest value so far."""
    rows = _rows(signals, fee, cell)
    starts = _cells(_summaries(rows)).select("ticker", CELL, "start", "base", "peak", "ticker_close")
    is_long = F.col("start") == LONG

    def picked(name: str) -> Column:
        return F.when(is_long, F.col(f"{name}{LONG}")).otherwise(F.col(f"{name}{FLAT}"))

    log_value = F.col("base") + picked("_path")
    log_peak = F.greatest(F.col("peak"), F.col("base") + picked("_peak"))
    return rows.join(starts, ["ticker", CELL], "left").select(
        "ticker",
        F.timestamp_micros(US).alias("timestamp"),
        "close",
        F.coalesce("_now", "start").alias("position"),
        (F.lit(cash) * F.exp(log_value)).alias("value"),
        F.expm1(log_value).alias("cumulative_return"),
        (F.col("close") / F.col("ticker_close") - 1).alias("benchmark_cumulative_return"),
        F.expm1(log_value - log_peak).alias("drawdown"),
    )


def benchmark_curve(bars: DataFrame, cell: str = DEFAULT_CELL) -> DataFrame:
    """Buy and hold from each ticker's first close, without fee."""
    rows = with_cells(bars.filter(F.col("close") > 0).select("ticker", "timestamp", "close"), cell)
    first = (
        rows.groupBy("ticker", CELL)
        .agg(F.min_by("close", F.col(US)).alias("_first"))
        .withColumn(
            "_first",
            F.first("_first").over(
                over_cells().rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
    )
    return rows.join(first, ["ticker", CELL], "left").select(
        "ticker",
        F.timestamp_micros(US).alias("timestamp"),
        "close",
        (F.col("close") / F.col("_first") - 1).alias("benchmark_cumulative_return"),
    )


def _sharpe(sum1: str, sum2: str) -> Column:
    n = F.col("n_bars")
    variance = (F.col(sum2) - F.col(sum1) * F.col(sum1) / n) / (n - 1)
    yearly = F.sqrt(F.lit(float(YEAR_US)) / F.col("spacing_us"))
    return F.when(variance > 0, F.col(sum1) / n / F.sqrt(variance) * yearly)


def backtest_summary(
    signals: DataFrame,
    fee: float = FEE,
    spacing: DataFrame | None = None,
    tickers: Sequence[str] | None = None,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    """One row per ticker. ``status`` says why a ticker has no figures: it has
    fewer than three bars, or was asked for and has none.

    Cells reduce to sums, extremes and last values, so no row-level join is
    needed. ``spacing`` (from ``bar_spacing``) is worked out from the signal
    rows if not given; pass it when the bars are at hand, they are cheaper.
    """
    if spacing is None:
        spacing = bar_spacing(signals.filter(F.col("close") > 0), cell)
    result = _figures(_summaries(_rows(signals, fee, cell)), spacing)
    if tickers is None:
        return result
    asked = signals.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    return asked.join(result, "ticker", "left").withColumns(
        {
            "status": F.coalesce("status", F.lit("no_bars")),
            "n_bars": F.coalesce("n_bars", F.lit(0).cast("long")),
        }
    )


def _figures(summaries: DataFrame, spacing: DataFrame) -> DataFrame:
    """One row of figures per ticker."""
    first_gain = F.expm1(F.col("first") + F.col("shift"))
    first_hold = F.expm1("gap")
    low = F.least(F.col("fall"), F.col("base") + F.col("low") - F.col("peak"))
    totals = (
        _cells(summaries)
        .groupBy("ticker")
        .agg(
            F.sum("n").alias("n_bars"),
            F.sum("added").alias("log_return"),
            F.min(low).alias("log_fall"),
            F.sum(F.col("gain1") + first_gain).alias("gain1"),
            F.sum(F.col("gain2") + first_gain * first_gain).alias("gain2"),
            F.sum(F.col("hold1") + first_hold).alias("hold1"),
            F.sum(F.col("hold2") + first_hold * first_hold).alias("hold2"),
            (F.max_by("last_close", F.col(CELL)) / F.min_by("first_close", F.col(CELL))).alias("hold"),
        )
        .join(spacing, "ticker", "left")
    )
    enough = F.col("n_bars") >= MIN_BARS
    return totals.select(
        "ticker",
        F.when(enough, "ok").otherwise("too_few_bars").alias("status"),
        "n_bars",
        F.when(enough, F.expm1("log_return") * 100).alias("total_return_pct"),
        F.when(enough, _sharpe("gain1", "gain2")).alias("sharpe_ratio"),
        F.when(enough, F.expm1(F.least(F.lit(0.0), F.col("log_fall"))) * 100).alias("max_drawdown_pct"),
        F.when(enough, (F.col("hold") - 1) * 100).alias("benchmark_total_return_pct"),
        F.when(enough, _sharpe("hold1", "hold2")).alias("benchmark_sharpe_ratio"),
    )


# --- stored summaries ----------------------------------------------------------


def cell_summaries(signals: DataFrame, fee: float = FEE, cell: str = DEFAULT_CELL) -> DataFrame:
    """``CELL_SUMMARY`` rows of ``signals``, stamped with their cell's start: what
    the figures need of each cell, and the distances between its bars."""
    rows = _rows(signals, fee, cell)
    gaps = rows.select("ticker", CELL, (F.col(US) - F.lag(US).over(in_cell())).alias("gap"))
    counted = gaps.filter("gap is not null").groupBy("ticker", CELL, "gap").agg(F.count(F.lit(1)).alias("n"))
    lists = counted.groupBy("ticker", CELL).agg(F.collect_list(F.struct("gap", "n")).alias("gaps"))
    edges = rows.groupBy("ticker", CELL).agg(F.min(US).alias("first_us"), F.max(US).alias("last_us"))
    both = _summaries(rows).join(edges, ["ticker", CELL]).join(lists, ["ticker", CELL], "left")
    return both.withColumn("timestamp", F.timestamp_micros(CELL)).select(*CELL_SUMMARY.names)


def spacing_of_summaries(summaries: DataFrame) -> DataFrame:
    """``bar_spacing`` of the bars behind the summaries."""
    cells = summaries.withColumn(CELL, F.unix_micros("timestamp"))
    inside = cells.select("ticker", F.inline("gaps"))
    edges = cells.select(
        "ticker", (F.col("first_us") - F.lag("last_us").over(over_cells())).alias("gap"), F.lit(1).cast("long").alias("n")
    )
    counted = inside.unionByName(edges).groupBy("ticker", "gap").agg(F.sum("n").alias("n"))
    return weighted_median(counted, ["ticker"], "gap", "n", "spacing_us")


def figures_of_summaries(summaries: DataFrame) -> DataFrame:
    """``backtest_summary`` of the bars behind the summaries; cells whose bars are
    all gone have none."""
    held = summaries.filter("n > 0")
    return _figures(held.withColumn(CELL, F.unix_micros("timestamp")), spacing_of_summaries(held))


def summary_view(summary: DataFrame) -> DataFrame:
    """Figures to three places, and the return over the benchmark in points."""
    places = 3
    names = (
        "total_return_pct",
        "sharpe_ratio",
        "max_drawdown_pct",
        "benchmark_total_return_pct",
        "benchmark_sharpe_ratio",
    )
    rounded = summary.withColumns({name: F.round(name, places) for name in names})
    return rounded.withColumn(
        "excess_return_points",
        F.round(F.col("total_return_pct") - F.col("benchmark_total_return_pct"), places),
    )
