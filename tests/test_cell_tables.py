"""Series stored by cell: equal frames, and neither bars nor buckets shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pitflow.functions.shared import shared_folder
from pitflow.operators.asof import asof_align
from pitflow.operators.signals import build_signal_frame
from pitflow.plans.research import StoredSeries
from pitflow.schemas import SIDE
from pitflow.sources.cell_tables import VERSION
from tests.helpers import bars, buckets, plus


def series(spark, overlap="4h", cell="12h", groups=4):
    path = shared_folder(spark, "cells")
    return StoredSeries.at(path.rsplit("/", 1)[1].replace("-", "_"), path, overlap, cell, groups)


def sample(spark, seed=3, n=150):
    r = random.Random(seed)
    prices = {(t, r.randint(0, 9000)): r.uniform(1, 9) for t in "ABC" for _ in range(n)}
    means = {(t, 15 * r.randint(0, 600)): r.choice([None, r.uniform(-1, 1)]) for t in "ABD" for _ in range(n // 5)}
    return (
        bars(spark, [(t, plus("00:00", m), p) for (t, m), p in prices.items()]),
        buckets(spark, [(t, plus("00:00", m), s, 2, s, None) for (t, m), s in means.items()]),
    )


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    got, want = (sorted(map(repr, f.select(*sorted(want.columns)).collect())) for f in (got, want))
    assert got == want and want


@pytest.mark.parametrize("cell", ["1d", "12h", "1h"])
def test_frames_of_stored_series_equal_unstored_ones(spark, cell):
    prices, means = sample(spark)
    stored = series(spark, cell=cell)
    stored.add_bars(prices, 0)
    stored.add_buckets(means, 0)
    aligned = asof_align(prices, means)
    same(stored.asof_align(spark), aligned)
    same(stored.signal_frame(spark, "1h", ("1h", "4h")), build_signal_frame(aligned, "1h", ("1h", "4h")))


def test_later_versions_replace_and_a_version_may_run_again(spark):
    prices, means = sample(spark)
    stored = series(spark)
    stored.add_buckets(means.filter("ticker = 'A'"), 0)
    stored.add_buckets(means, 1)
    stored.add_bars(prices.selectExpr("ticker", "timestamp", "open", "high", "low", "close * 2 as close", "volume"), 0)
    for _ in range(2):
        stored.add_bars(prices, 1)
    same(stored.asof_align(spark), asof_align(prices, means))


def test_a_new_session_finds_the_table_by_its_folder(spark):
    prices, means = sample(spark)
    first = series(spark)
    first.add_bars(prices, 0)
    first.add_buckets(means, 0)
    again = StoredSeries.at(first.table.name + "_again", first.table.path, "4h", "12h", 4)
    same(again.asof_align(spark), asof_align(prices, means))


def test_empty_series_and_rows_without_key(spark):
    prices, means = sample(spark, n=10)
    stored = series(spark)
    assert stored.asof_align(spark).count() == stored.signal_frame(spark, "1h", ("1h",)).count() == 0
    odd = bars(spark, [(None, plus("00:00", 1), 1.0), ("A", None, 1.0)])
    stored.add_bars(prices.unionByName(odd), 0)
    same(stored.asof_align(spark), asof_align(prices, means.limit(0)))


def test_windows_wider_than_the_overlap_are_refused(spark):
    stored = series(spark)
    with pytest.raises(ValueError, match="up to 4h"):
        stored.signal_frame(spark, "1h", ("1h", "24h"))
    with pytest.raises(ValueError, match="not one of"):
        stored.signal_frame(spark, "15m", ("1h",))


def plan(df):
    df.toPandas()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]


def test_a_folded_table_holds_what_counts_in_one_file_a_group(spark):
    prices, means = sample(spark)
    stored = series(spark)
    for version in range(3):
        stored.add_bars(prices.withColumn("close", F.col("close") + (2 - version)), version)
    stored.add_buckets(means.filter("ticker = 'A'"), 0)
    path = shared_folder(spark, "folded")
    for _ in range(2):  # a fold that runs again replaces what it wrote
        folded = StoredSeries(stored.table.fold(spark, stored.table.name + "_folded", path))
    raw = spark.read.parquet(path)
    assert raw.filter(F.col(SIDE) == 0).select(VERSION).distinct().collect() == [(2,)]
    assert 0 < len(raw.inputFiles()) <= 4 < len(spark.read.parquet(stored.table.path).inputFiles())
    same(folded.asof_align(spark), asof_align(prices, means.filter("ticker = 'A'")))
    folded.add_buckets(means, 3)
    same(folded.asof_align(spark), asof_align(prices, means))


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_neither_bars_nor_buckets_are_shuffled(spark, broadcast):
    """The only exchanges are those of carry rows, one per (ticker, cell): they stand
    above an aggregate by (ticker, cell) or the window over its rows."""
    prices, means = sample(spark)
    stored = series(spark)
    stored.add_bars(prices, 0)
    stored.add_buckets(means, 0)
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, broadcast)
    try:
        texts = [plan(f) for f in (stored.asof_align(spark), stored.signal_frame(spark, "1h", ("1h", "4h")))]
    finally:
        spark.conf.set(name, before)
    step = r"[ :+|-]*(?:\*\(\d+\) )?"
    passing = rf"(?:{step}(?:Project|Filter|Sort) [^\n]*\n)*"
    for text in texts:
        assert "Bucketed: true" in text and "Bucketed: false" not in text and "Union" not in text
        below = re.findall(rf"Exchange (\w+)[^\n]*\n{passing}{step}(\w+)", text)
        fresh = [line for line in text.splitlines() if "Exchange " in line and "ReusedExchange" not in line]
        assert len(below) == len(fresh)
        assert below and {node for _, node in below} <= {"SortAggregate", "ObjectHashAggregate", "Window"}, text
        # a window under an exchange is that over carry rows: one partition column
        for window in re.findall(rf"Exchange [^\n]*\n{passing}{step}Window ([^\n]*)", text):
            assert re.search(r"\], \[ticker#\d+\], \[_cell#\d+L", window), window
