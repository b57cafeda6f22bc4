"""Backtest figures kept up to date as bars are added and corrected.

Signal rows are a live table, and the summaries of their cells are another one.
A batch of rows touches some cells; only those are read and summed up anew. The
figures of a ticker come from its summaries, one per cell, however many bars.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitflow.functions.cells import CELL, DEFAULT_CELL, cell_start, placed
from pitflow.functions.durations import duration_us
from pitflow.operators.backtest import cell_summaries, figures_of_summaries
from pitflow.schemas import CELL_SUMMARY, FEE, SIGNAL_ROW, TRIGGER
from pitflow.sources.live import FOLD_EVERY, LiveTable, keyed_table
from pitflow.sources.tables import DEFAULT_FEED

KEY = ("ticker", "timestamp")


@dataclass(frozen=True)
class BacktestTables:
    signals: LiveTable
    cells: LiveTable

    @classmethod
    def at(cls, root: str) -> "BacktestTables":
        return cls(keyed_table(f"{root}/signals", SIGNAL_ROW, KEY), keyed_table(f"{root}/cells", CELL_SUMMARY, KEY))

    def figures(self, spark: SparkSession) -> DataFrame:
        """``backtest_summary`` of all bars so far."""
        return figures_of_summaries(self.cells.current(spark))


def backtest_batch(
    rows: DataFrame,
    batch_id: int,
    tables: BacktestTables,
    fee: float = FEE,
    cell: str = DEFAULT_CELL,
    feed: str = DEFAULT_FEED,
    fold_every: int = FOLD_EVERY,
) -> None:
    """Takes ``SIGNAL_ROW`` rows in, new bars and corrected ones, and sums up the
    cells they touch. A bar sent again replaces its older version. A batch that runs
    again replaces what it wrote. One job may keep the tables."""
    spark = rows.sparkSession
    width = duration_us(cell)

    def of_cell(df: DataFrame) -> DataFrame:
        return df.withColumn(CELL, cell_start(F.unix_micros("timestamp"), width))

    rows = placed(rows).persist()
    try:
        tables.signals.write(rows, batch_id, feed, key=KEY)
        touched = of_cell(rows).select("ticker", CELL).distinct().persist()
        days = touched.agg(F.min(CELL).alias("low"), F.max(CELL).alias("high")).first()
        stored = of_cell(tables.signals.rows(spark))
        if days["low"] is not None:
            # Dates of the touched cells reach the scan; the cells themselves meet in a join.
            low, high = (F.timestamp_micros(F.lit(us)) for us in (days["low"], days["high"] + width))
            stored = stored.filter((F.col("timestamp") >= low) & (F.col("timestamp") < high))
        near = stored.join(touched, ["ticker", CELL], "left_semi").drop(CELL)
        current = tables.signals.resolve(near).select(*SIGNAL_ROW.names)
        summaries = cell_summaries(current, fee, cell)
        # A cell whose bars lost their price has a summary of no bars.
        every = touched.select("ticker", F.timestamp_micros(CELL).alias("timestamp"))
        written = every.join(summaries, list(KEY), "left").fillna(0, ["n"])
        tables.cells.take(written, batch_id, feed, fold_every)
        tables.signals.fold_now_and_then(spark, batch_id, feed, fold_every)
        touched.unpersist()
    finally:
        rows.unpersist()


def start_backtests(
    signals: DataFrame,
    tables: BacktestTables,
    checkpoint: str,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    return (
        signals.writeStream.foreachBatch(lambda batch, batch_id: backtest_batch(batch, batch_id, tables, **options))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )
