"""From scored posts and bars to signals and backtest figures, as one plan."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitflow.functions.cells import CELL, DEFAULT_CELL, US, leave_cells
from pitflow.operators.asof import align_stored, home_rows
from pitflow.operators.backtest import backtest_summary, equity_curve
from pitflow.operators.sentiment import aggregate_sentiment
from pitflow.operators.signals import signal_frame_in_cells, signals_of_aligned, widest_us
from pitflow.schemas import (
    BAR,
    BARS_FIRST,
    BUCKET_COLUMNS,
    BUCKET_STRUCT,
    BUCKET_WINDOW,
    BUCKETS_SECOND,
    ENTRY_THRESHOLD,
    EXIT_THRESHOLD,
    FEE,
    INITIAL_CASH,
    ROLLING_WINDOWS,
    SERIES_ROW,
    SIDE,
    SIGNAL_WINDOW,
)
from pitflow.sources.bars import bar_spacing
from pitflow.sources.cell_tables import GROUPS, CellTable


def signal_frame(
    scored: DataFrame,
    bars: DataFrame,
    label: str = SIGNAL_WINDOW,
    bucket: str = BUCKET_WINDOW,
    windows: Sequence[str] = ROLLING_WINDOWS,
    entry_threshold: float = ENTRY_THRESHOLD,
    exit_threshold: float = EXIT_THRESHOLD,
    cell: str = DEFAULT_CELL,
) -> DataFrame:
    """Bars with bucket means, rolling means and signals."""
    if label not in windows:
        raise ValueError(f"signal window {label!r} is not one of the rolling windows {tuple(windows)}")
    buckets = aggregate_sentiment(scored, bucket)
    frame = signal_frame_in_cells(
        bars, buckets, label, windows, entry_threshold, exit_threshold, cell
    )
    return leave_cells(frame)


def _signals_in_cells(
    scored: DataFrame,
    bars: DataFrame,
    label: str,
    bucket: str = BUCKET_WINDOW,
    windows: Sequence[str] = (),
    **options,
) -> DataFrame:
    narrow = bars.select("ticker", "timestamp", "close")
    buckets = aggregate_sentiment(scored, bucket).select("ticker", "timestamp", "avg_sentiment")
    frame = signal_frame_in_cells(narrow, buckets, label, windows or (label,), **options)
    return frame.select("ticker", "close", "entry_signal", "exit_signal", CELL, US)


def trading_signals(scored: DataFrame, bars: DataFrame, label: str = SIGNAL_WINDOW, **options) -> DataFrame:
    """Only what a backtest reads. The narrow inputs keep every shuffle narrow,
    and only the signal's own window is rolled. Frames of several labels over the
    same bars that name the same ``windows`` share one shuffle of the bars."""
    return leave_cells(_signals_in_cells(scored, bars, label, **options))


def backtest(
    scored: DataFrame, bars: DataFrame, label: str = SIGNAL_WINDOW, fee: float = FEE, **options
) -> DataFrame:
    """One row of figures per ticker."""
    signals = _signals_in_cells(scored, bars, label, **options)
    return backtest_summary(signals, fee, bar_spacing(bars.filter("close > 0")))


def equity(
    scored: DataFrame,
    bars: DataFrame,
    label: str = SIGNAL_WINDOW,
    cash: float = INITIAL_CASH,
    fee: float = FEE,
    **options,
) -> DataFrame:
    """One row of position, value and returns per bar."""
    return equity_curve(_signals_in_cells(scored, bars, label, **options), cash, fee)


@dataclass(frozen=True)
class StoredSeries:
    """Bars and buckets kept in one cell table. Its frames equal those of the same bars
    and buckets unstored, and shuffle neither. Later versions replace bars and buckets."""

    table: CellTable

    @classmethod
    def at(
        cls, name: str, path: str, overlap: str, cell: str = DEFAULT_CELL, groups: int = GROUPS
    ) -> "StoredSeries":
        """``overlap`` is the widest rolling window that frames will ask for."""
        return cls(CellTable(name, path, SERIES_ROW, cell, overlap, groups, also=(SIDE,)))

    def add_bars(self, bars: DataFrame, version: int) -> None:
        nothing = F.lit(None).cast(SERIES_ROW[BUCKET_STRUCT].dataType)
        self.table.add(bars.withColumns({SIDE: F.lit(BARS_FIRST), BUCKET_STRUCT: nothing}), version)

    def add_buckets(self, buckets: DataFrame, version: int) -> None:
        packed = {SIDE: F.lit(BUCKETS_SECOND), BUCKET_STRUCT: F.struct(*BUCKET_COLUMNS)}
        prices = [f for f in BAR.fields if f.name not in ("ticker", "timestamp")]
        empty = {f.name: F.lit(None).cast(f.dataType) for f in prices}
        self.table.add(buckets.withColumns({**packed, **empty}), version)

    def _aligned(self, spark: SparkSession) -> DataFrame:
        return align_stored(self.table.rows(spark), self.table.cell, self.table.overlap_us)

    def asof_align(self, spark: SparkSession) -> DataFrame:
        return leave_cells(home_rows(self._aligned(spark)))

    def signal_frame(
        self,
        spark: SparkSession,
        label: str = SIGNAL_WINDOW,
        windows: Sequence[str] = ROLLING_WINDOWS,
        entry_threshold: float = ENTRY_THRESHOLD,
        exit_threshold: float = EXIT_THRESHOLD,
    ) -> DataFrame:
        if label not in windows:
            raise ValueError(f"signal window {label!r} is not one of the rolling windows {tuple(windows)}")
        if widest_us(windows) > self.table.overlap_us:
            raise ValueError(f"the series is stored for windows up to {self.table.overlap}")
        aligned = self._aligned(spark)
        return leave_cells(signals_of_aligned(aligned, label, windows, entry_threshold, exit_threshold))
