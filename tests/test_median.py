import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitflow.operators.median import weighted_median
from pitflow.sources.bars import bar_spacing
from tests.helpers import at, bars, plus


def medians(spark, rows):
    frame = spark.createDataFrame(rows, "ticker string, gap long, n long")
    return {r.ticker: r.m for r in weighted_median(frame, ["ticker"], "gap", "n", "m").collect()}


def test_against_sorted_values(spark):
    r = random.Random(1)
    rows, plain = [], {}
    for t in range(30):
        for _ in range(r.randint(1, 40)):
            gap, n = r.choice([0, 1, 900_000_000, r.randrange(2**56), r.randrange(2000), 2**19, 2**38 - 1]), r.randint(1, 4)
            rows.append((f"T{t}", gap, n))
            plain.setdefault(f"T{t}", []).extend([gap] * n)
    got = medians(spark, rows)
    assert got.keys() == plain.keys()
    for ticker, values in plain.items():
        assert got[ticker] == pytest.approx(statistics.median(values), rel=1e-15)


def test_nulls_negatives_and_nothing(spark):
    assert medians(spark, [("A", None, 1), ("A", -5, 9), ("B", 3, 1), ("B", 4, 1)]) == {"B": 3.5}
    assert medians(spark, []) == {}


def test_spacing_of_irregular_bars(spark):
    r = random.Random(2)
    times = sorted(r.sample(range(100_000), 501))
    frame = bars(spark, [("A", plus("00:00", m / 7), 1.0) for m in times] + [("B", at("10:00"), 1.0)])
    stamps = sorted(r.us for r in frame.filter("ticker = 'A'").select(F.unix_micros("timestamp").alias("us")).collect())
    want = statistics.median(b - a for a, b in zip(stamps, stamps[1:]))
    for cell in ("7d", "6h"):
        assert [(r.ticker, r.spacing_us) for r in bar_spacing(frame, cell).collect()] == [("A", want)]


def test_no_window_over_a_ticker(spark):
    frame = bars(spark, [("A", plus("00:00", m), 1.0) for m in (0, 1, 3, 9)])
    spacing = bar_spacing(frame)
    spacing.collect()
    plan = spacing._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    # gaps within a cell, and one carry row per cell
    assert windows and all("_cell" in line for line in windows)
