"""The backtest against hand-worked values and a plain loop."""

import math
import random

import pytest

from pitflow.operators.backtest import (
    backtest_summary,
    benchmark_curve,
    equity_curve,
    summary_view,
)
from pitflow.sources.bars import bar_spacing
from tests.helpers import ordered, plus

FEE = 0.001


def signal_rows(spark, rows):
    return spark.createDataFrame(
        rows, "ticker string, timestamp timestamp, close double, entry_signal boolean, exit_signal boolean"
    )


def series(ticker, closes, entries=(), exits=(), step=15):
    return [
        (ticker, plus("10:00", step * i), float(c), i in entries, i in exits) for i, c in enumerate(closes)
    ]


@pytest.mark.parametrize("cell", ["7d", "15m", "30m"])
@pytest.mark.parametrize("entries", [(1,), (1, 2)])
def test_hand_worked(spark, cell, entries):
    frame = signal_rows(spark, series("A", [100, 100, 110, 121], entries, (3,)))
    values = ordered(equity_curve(frame, cash=1.0, cell=cell), "value")
    assert values == pytest.approx([1, 1 / 1.001, 1.1 / 1.001, 1.21 * 0.999 / 1.001])
    row = summary_view(backtest_summary(frame, cell=cell)).first()
    assert (row.status, row.n_bars) == ("ok", 4)
    assert row.total_return_pct == 20.758
    assert row.benchmark_total_return_pct == 21.0
    assert row.max_drawdown_pct == -0.1
    assert row.excess_return_points == -0.242


def test_open_position_is_marked_to_market(spark):
    frame = signal_rows(spark, series("A", [100, 100, 110, 121], (1,)))
    assert ordered(equity_curve(frame, cash=1.0), "value")[-1] == pytest.approx(1.21 / 1.001)


def test_too_few_bars_and_flat(spark):
    rows = series("FEW", [1, 2]) + series("FLAT", [1, 2, 3, 4])
    found = {r.ticker: r for r in backtest_summary(signal_rows(spark, rows), tickers=["FEW", "FLAT", "NONE"]).collect()}
    assert found["FEW"].status == "too_few_bars" and found["FEW"].total_return_pct is None
    assert found["FLAT"].status == "ok"
    assert found["FLAT"].total_return_pct == 0 and found["FLAT"].sharpe_ratio is None
    assert (found["NONE"].status, found["NONE"].n_bars) == ("no_bars", 0)


def test_entry_and_exit_on_one_bar_change_nothing(spark):
    frame = signal_rows(spark, series("A", [100, 110, 121, 130], (1,), (1,)))
    assert ordered(equity_curve(frame, cash=1.0), "position") == [0, 0, 0, 0]


def loop_backtest(closes, entries, exits, step_us):
    """Share by share, the way one would by hand."""
    cash, shares, values, peak, worst, returns, was = 1.0, 0.0, [], 1.0, 0.0, [], 1.0
    for close, entry, exit_ in zip(closes, entries, exits):
        if entry and not exit_ and shares == 0:
            shares, cash = cash / (close * (1 + FEE)), 0.0
        elif exit_ and not entry and shares > 0:
            cash, shares = shares * close * (1 - FEE), 0.0
        value = cash + shares * close
        values.append(value)
        returns.append(value / was - 1)
        was, peak = value, max(peak, value)
        worst = min(worst, value / peak - 1)
    mean = sum(returns) / len(returns)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in returns) / (len(returns) - 1))
    sharpe = mean / deviation * math.sqrt(365 * 86_400e6 / step_us) if deviation else None
    return values, worst, sharpe


@pytest.mark.parametrize("cell", ["7d", "1d", "2h"])
def test_against_a_loop(spark, cell):
    chance = random.Random(7)
    rows, expected = [], {}
    for ticker in ("A", "B", "C"):
        closes, entries, exits = [100.0], [], []
        for _ in range(599):
            closes.append(closes[-1] * math.exp(chance.gauss(0, 0.01)))
        entries = [chance.random() < 0.05 for _ in closes]
        exits = [chance.random() < 0.05 for _ in closes]
        rows += [
            (ticker, plus("10:00", 15 * i), *bar) for i, bar in enumerate(zip(closes, entries, exits))
        ]
        expected[ticker] = loop_backtest(closes, entries, exits, 15 * 60e6)
    frame = signal_rows(spark, rows)
    curve = equity_curve(frame, cash=1.0, fee=FEE, cell=cell)
    summary = {r.ticker: r for r in backtest_summary(frame, FEE, cell=cell).collect()}
    for ticker, (values, worst, sharpe) in expected.items():
        mine = curve.filter(f"ticker = '{ticker}'")
        assert ordered(mine, "value") == pytest.approx(values, rel=1e-12)
        assert min(ordered(mine, "drawdown")) == pytest.approx(worst, rel=1e-9)
        assert summary[ticker].total_return_pct == pytest.approx((values[-1] - 1) * 100, rel=1e-9)
        assert summary[ticker].max_drawdown_pct == pytest.approx(worst * 100, rel=1e-9)
        assert summary[ticker].sharpe_ratio == pytest.approx(sharpe, rel=1e-9)


def test_spacing_is_the_median_gap(spark):
    minutes = {"GRID": [0, 15, 30, 45], "ODD": [0, 1, 3, 20_000], "EVEN": [0, 1, 3], "ONE": [0]}
    rows = [(t, plus("10:00", m), 1.0) for t, ms in minutes.items() for m in ms]
    frame = spark.createDataFrame(rows, "ticker string, timestamp timestamp, close double")
    for cell in ("7d", "1h", "1m"):
        found = {r.ticker: r.spacing_us / 60e6 for r in bar_spacing(frame, cell).collect()}
        assert found == {"GRID": 15, "ODD": 2, "EVEN": 1.5}


def test_benchmark_starts_at_the_first_close(spark):
    frame = signal_rows(spark, series("A", [50, 100, 25], step=60 * 24 * 30))
    assert ordered(benchmark_curve(frame), "benchmark_cumulative_return") == [0, 1, -0.5]
