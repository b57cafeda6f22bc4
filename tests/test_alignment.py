"""Buckets, the as-of join, rolling means and signals on hand-worked rows."""

import pytest

from pitflow.operators.asof import align_sentiment_with_price, asof_align
from pitflow.operators.sentiment import aggregate_sentiment
from pitflow.operators.signals import add_rolling_sentiment, build_signal_frame, generate_signals
from pitflow.plans.research import signal_frame
from tests.helpers import at, bars, buckets, ordered, plus, scored


def test_bucket_edge_is_not_visible_to_the_bar_at_that_instant(spark):
    posts = scored(spark, [("A", at("10:00"), 1.0), ("A", at("10:14:59.999999"), 0.0)])
    assert ordered(aggregate_sentiment(posts), "timestamp", "avg_sentiment", "post_count") == [
        (at("10:15").replace(tzinfo=None), 0.5, 2)
    ]
    prices = bars(spark, [("A", at(t), 1.0) for t in ("10:00", "10:15", "10:30")])
    aligned = align_sentiment_with_price(posts, prices)
    assert ordered(aligned, "avg_sentiment", "post_count") == [(0.0, 0), (0.0, 0), (0.5, 2)]


def test_post_on_the_edge_belongs_to_the_next_bucket(spark):
    found = aggregate_sentiment(scored(spark, [("A", at("10:15"), 1.0)]))
    assert ordered(found, "timestamp") == [at("10:30").replace(tzinfo=None)]


@pytest.mark.parametrize("later", ["2024-01-05 10:00", "2024-03-01 00:00", "2031-01-01 00:00"])
def test_carry_has_no_limit(spark, later):
    prices = bars(spark, [("A", at(later), 1.0)])
    found = asof_align(prices, buckets(spark, [("A", at("10:15"), 0.5, 1, 0.7, 0.2)]))
    assert ordered(found, "avg_sentiment", "avg_positive") == [(0.5, 0.7)]


def test_tickers_without_posts_keep_their_bars_and_the_reverse_vanishes(spark):
    prices = bars(spark, [("B", at("11:00"), 1.0)])
    found = asof_align(prices, buckets(spark, [("C", at("10:15"), 0.5, 1, 0.7, 0.2)]))
    assert ordered(found, "ticker", "avg_sentiment", "post_count", "avg_positive") == [("B", 0.0, 0, None)]


def test_the_whole_bucket_is_carried_not_its_columns(spark):
    found = asof_align(
        bars(spark, [("A", at("10:45"), 1.0)]),
        buckets(
            spark,
            [("A", at("10:15"), 0.1, 1, 0.7, 0.2), ("A", at("10:30"), 0.2, 1, None, 0.1)],
        ),
    )
    assert ordered(found, "avg_sentiment", "avg_positive", "avg_negative") == [(0.2, None, 0.1)]


def test_buckets_without_scores_are_dropped_and_nan_is_missing(spark):
    posts = scored(
        spark,
        [("A", at("10:01"), 0.5), ("A", at("10:16"), None), ("A", at("10:31"), float("nan")), ("A", at("10:32"), 0.25)],
    )
    found = aggregate_sentiment(posts)
    assert ordered(found, "avg_sentiment", "post_count") == [(0.5, 1), (0.25, 1)]


def test_bucket_width_has_to_divide_a_day(spark):
    with pytest.raises(ValueError):
        aggregate_sentiment(scored(spark, [("A", at("10:00"), 1.0)]), "7h")


def rolled(spark, values, windows, step=15):
    rows = [("A", plus("10:00", step * i), float(v)) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "ticker string, timestamp timestamp, avg_sentiment double")
    return add_rolling_sentiment(frame, windows)


def test_rolling_frame_is_open_on_the_left(spark):
    found = rolled(spark, [1, 2, 3, 4, 5], ("15m", "1h"))
    assert ordered(found, "sentiment_roll_15m") == [1, 2, 3, 4, 5]
    assert ordered(found, "sentiment_roll_1h") == [1, 1.5, 2, 2.5, 3.5]


def test_rolling_mean_of_a_constant_is_exactly_that_constant(spark):
    found = rolled(spark, [0.4] * 30, ("4h",))
    assert ordered(found, "sentiment_roll_4h") == [0.4] * 30


def signals_of(spark, values, start="10:00", step=15, **options):
    rows = [("A", plus(start, step * i), v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "ticker string, timestamp timestamp, sentiment_roll_1h double")
    return generate_signals(frame, **options)


def test_crossings(spark):
    up = signals_of(spark, [0.4, 0.41, 0.5, 0.4, 0.41])
    assert ordered(up, "entry_signal") == [False, True, False, False, True]
    down = signals_of(spark, [-0.2, -0.21, -0.3])
    assert ordered(down, "exit_signal") == [False, True, False]
    assert ordered(signals_of(spark, [0.9]), "entry_signal") == [False]


def test_crossing_between_distant_cells(spark):
    found = signals_of(spark, [0.1, 0.9, 0.95, -0.9], step=60 * 24 * 40)
    assert ordered(found, "entry_signal") == [False, True, False, False]
    assert ordered(found, "exit_signal") == [False, False, False, True]


def test_null_values_never_cross(spark):
    found = signals_of(spark, [0.1, None, 0.9, 0.1], cell="1h")
    assert ordered(found, "entry_signal", "exit_signal") == [(False, False)] * 4


def test_missing_rolling_column_is_an_error(spark):
    with pytest.raises(ValueError):
        signals_of(spark, [0.1], label="4h")


def test_stepwise_and_fused_frames_agree(spark):
    posts = scored(spark, [("A", plus("00:00", 37 * i), ((i * 37) % 41) / 20 - 1) for i in range(900)])
    prices = bars(spark, [("A", plus("00:00", 15 * i), 100.0 + i % 7) for i in range(2400) if i % 500 < 300])
    fused = signal_frame(posts, prices)
    stepwise = build_signal_frame(align_sentiment_with_price(posts, prices))
    columns = fused.columns
    assert sorted(columns) == sorted(stepwise.columns)
    assert ordered(fused, *columns) == ordered(stepwise, *columns)
