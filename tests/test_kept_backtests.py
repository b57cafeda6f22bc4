"""Figures from stored cell summaries, and ids dropped over all history."""

import random

import pytest

from pitflow.functions.rocks import STORE, with_rocks
from pitflow.functions.shared import shared_folder
from pitflow.operators.backtest import backtest_summary, cell_summaries, figures_of_summaries
from pitflow.schemas import SIGNAL_ROW
from pitflow.sources.tables import DEFAULT_FEED
from pitflow.streaming.backtests import BacktestTables, backtest_batch
from pitflow.streaming.ingest import dedupe_stream
from tests.helpers import plus, scored

HOUR = 60


def signals(spark, rows):
    return spark.createDataFrame(rows, SIGNAL_ROW)


def bars(n, seed=1, tickers="AB"):
    r = random.Random(seed)
    return [
        (t, plus("00:00", HOUR * i + r.randint(0, 20)), 100 + r.uniform(-9, 9), r.random() < 0.1, r.random() < 0.1)
        for t in tickers
        for i in range(n)
    ]


def plain(frame):
    return {r.ticker: tuple(None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v for v in r) for r in frame.collect()}


def check(spark, tables, rows, cell):
    want = plain(backtest_summary(signals(spark, rows), cell=cell))
    assert {r.ticker: tuple(r) for r in tables.figures(spark).collect()} == want


def test_summaries_give_the_figures_of_the_batch(spark):
    rows = bars(200) + [("C", plus("00:00", 5), 3.0, True, False), ("D", plus("00:00", 5), None, True, False)]
    for cell in ("7d", "12h", "1h"):
        got = figures_of_summaries(cell_summaries(signals(spark, rows), cell=cell))
        assert {r.ticker: tuple(r) for r in got.collect()} == plain(backtest_summary(signals(spark, rows), cell=cell))


def test_appended_and_corrected_bars(spark):
    tables = BacktestTables.at(shared_folder(spark, "kept"))
    rows = {r[:2]: r for r in bars(120)}
    parts = [list(rows.values())[k::3] for k in range(3)]  # each with bars of every cell
    known = {}
    for batch_id, part in enumerate(parts):
        backtest_batch(signals(spark, part), batch_id, tables, cell="12h", fold_every=2)
        known.update({r[:2]: r for r in part})
    check(spark, tables, list(known.values()), "12h")
    corrected = [(t, at, close * 1.5, not entry, exit_) for t, at, close, entry, exit_ in parts[1][:9]]
    backtest_batch(signals(spark, corrected), 3, tables, cell="12h")
    known.update({r[:2]: r for r in corrected})
    check(spark, tables, list(known.values()), "12h")
    backtest_batch(signals(spark, corrected[:4]), 3, tables, cell="12h")  # the batch again, with less
    for r in parts[1][4:9]:
        known[r[:2]] = r
    stale = {r[:2] for r in corrected[4:]}
    # cells that only the first attempt touched keep its summary until a batch touches them
    backtest_batch(signals(spark, [known[k] for k in stale]), 4, tables, cell="12h")
    check(spark, tables, list(known.values()), "12h")


def test_only_touched_cells_are_written(spark):
    tables = BacktestTables.at(shared_folder(spark, "touched"))
    rows = bars(100, tickers="A")
    backtest_batch(signals(spark, rows), 0, tables, cell="12h")
    backtest_batch(signals(spark, rows[50:51]), 1, tables, cell="12h")
    by_batch = {r["batch_id"]: r["count"] for r in tables.cells.rows(spark).groupBy("batch_id").count().collect()}
    assert by_batch == {0: 9, 1: 1}
    check(spark, tables, rows, "12h")


def test_cells_that_lose_all_bars_and_empty_batches(spark):
    tables = BacktestTables.at(shared_folder(spark, "lost"))
    rows = bars(30, tickers="A")
    backtest_batch(signals(spark, rows), 0, tables, cell="12h")
    gone = [(t, at, None, e, x) for t, at, _, e, x in rows[-8:]]
    backtest_batch(signals(spark, gone), 1, tables, cell="12h")
    backtest_batch(signals(spark, []), 2, tables, cell="12h")
    check(spark, tables, rows[:-8], "12h")
    tables.signals.fold(spark, {DEFAULT_FEED: 3})
    tables.cells.fold(spark, {DEFAULT_FEED: 3})
    check(spark, tables, rows[:-8], "12h")


def test_copies_ten_days_apart_come_once(spark):
    root = shared_folder(spark, "history")
    first = scored(spark, [("A", plus("00:00", i), 0.5) for i in range(5)])
    later = first.selectExpr("id", "ticker", "timestamp + interval 10 days as timestamp", "sentiment_score")
    later = later.unionByName(scored(spark, [("A", plus("00:00", 99_999), 0.1)]).select(*later.columns))
    stream = lambda: dedupe_stream(spark.readStream.schema(later.schema).parquet(f"{root}/in"), None)
    for part in (first.select(*later.columns), later):
        part.write.mode("append").parquet(f"{root}/in")
        writer = stream().writeStream.format("parquet").trigger(availableNow=True)
        writer = writer.option("checkpointLocation", f"{root}/checkpoint")
        with_rocks(spark, lambda: writer.start(f"{root}/out")).awaitTermination()
    ids = [r.id for r in spark.read.parquet(f"{root}/out").collect()]
    assert len(ids) == len(set(ids)) == 6
    assert "RocksDB" not in (spark.conf.get(STORE, None) or "")
