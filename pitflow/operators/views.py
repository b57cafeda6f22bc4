"""Series behind the charts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitflow.functions.text import direction
from pitflow.operators.signals import roll_column
from pitflow.schemas import SIGNAL_WINDOW


def chart_series(signals: DataFrame, label: str = SIGNAL_WINDOW, ticker: str | None = None) -> DataFrame:
    """Close and rolling sentiment with its direction. Without that rolling
    column the bucket mean is shown."""
    if ticker is not None:
        signals = signals.filter(F.col("ticker") == ticker)
    shown = roll_column(label) if roll_column(label) in signals.columns else "avg_sentiment"
    return signals.select(
        "ticker",
        "timestamp",
        "close",
        F.col(shown).alias("sentiment"),
        direction(F.col(shown)).alias("direction"),
    )


def returns_series(equity: DataFrame, ticker: str | None = None) -> DataFrame:
    """Strategy and benchmark cumulative returns in percent."""
    if ticker is not None:
        equity = equity.filter(F.col("ticker") == ticker)
    return equity.select(
        "ticker",
        "timestamp",
        (F.col("cumulative_return") * 100).alias("strategy_pct"),
        (F.col("benchmark_cumulative_return") * 100).alias("benchmark_pct"),
    )
