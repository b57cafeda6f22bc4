"""What has to hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from pitflow.plans.research import equity, signal_frame
from tests.helpers import at, bars, buckets, ordered, plus, scored


def random_inputs(spark, seed):
    """Irregular bars and posts over some weeks, with long gaps, one hot ticker."""
    chance = random.Random(seed)
    posts, prices = [], []
    for ticker, n in (("HOT", 600), ("B", 60), ("C", 5)):
        start = chance.randrange(20_000)
        minutes = sorted({start + chance.randrange(60_000) for _ in range(n)})
        prices += [(ticker, plus("2024-01-01 00:00", m), chance.uniform(50, 150)) for m in minutes]
        posts += [
            (ticker, plus("2024-01-01 00:00", chance.uniform(0, 60_000)), chance.uniform(-1, 1))
            for _ in range(2 * n)
        ]
    return posts, prices


def rolled_by_hand(values, windows_minutes, minutes):
    out = []
    for i, now in enumerate(minutes):
        row = []
        for w in windows_minutes:
            inside = [v for v, m in zip(values[: i + 1], minutes[: i + 1]) if m > now - w]
            row.append(sum(inside) / len(inside))
        out.append(row)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cell_width_does_not_matter(spark, seed):
    posts, prices = random_inputs(spark, seed)
    posts, prices = scored(spark, posts), bars(spark, prices)
    plain = signal_frame(posts, prices, cell="36500d")
    columns = plain.columns
    expected = ordered(plain, *columns)
    for cell in ("1d", "5h"):
        assert ordered(signal_frame(posts, prices, cell=cell), *columns) == expected
    curve = ordered(equity(posts, prices, cell="36500d"), "value")
    assert ordered(equity(posts, prices, cell="1d"), "value") == pytest.approx(curve, rel=1e-12)


def test_frame_against_brute_force(spark):
    post_rows, price_rows = random_inputs(spark, 3)
    found = ordered(
        signal_frame(scored(spark, post_rows), bars(spark, price_rows), cell="1d"),
        "ticker", "timestamp", "avg_sentiment", "post_count",
        "sentiment_roll_15m", "sentiment_roll_1h", "sentiment_roll_4h", "sentiment_roll_24h",
        "entry_signal", "exit_signal",
    )
    origin = at("2024-01-01 00:00")
    minute = lambda t: (t - origin).total_seconds() / 60
    position = 0
    for ticker in sorted({t for t, *_ in price_rows}):
        cells = {}
        for t, when, score in post_rows:
            if t == ticker:
                cells.setdefault((minute(when) // 15 + 1) * 15, []).append(score)
        minutes = sorted(minute(when) for t, when, _ in price_rows if t == ticker)
        matched = []
        for m in minutes:
            seen = [end for end in cells if end < m]
            matched.append(cells[max(seen)] if seen else [])
        means = [sum(c) / len(c) if c else 0.0 for c in matched]
        rolls = rolled_by_hand(means, (15, 60, 240, 1440), minutes)
        for i in range(len(minutes)):
            row = found[position + i]
            assert row[0] == ticker and row[3] == len(matched[i])
            assert row[2] == pytest.approx(means[i], abs=1e-12)
            assert row[4:8] == pytest.approx(rolls[i], abs=1e-12)
            before = rolls[i - 1][1] if i else None
            assert row[8] == (i > 0 and rolls[i][1] > 0.4 >= before)
            assert row[9] == (i > 0 and rolls[i][1] < -0.2 <= before)
        position += len(minutes)
    assert position == len(found)


@pytest.mark.parametrize("seed", [4, 5])
def test_later_posts_never_change_earlier_rows(spark, seed):
    posts, prices = random_inputs(spark, seed)
    cut = plus("2024-01-01 00:00", random.Random(seed).randrange(10_000, 50_000))
    changed = [(t, w, s if w < cut else -s) for t, w, s in posts]
    changed += [("HOT", cut, 1.0), ("C", cut, -1.0)]
    frames = [signal_frame(scored(spark, p), bars(spark, prices)) for p in (posts, changed)]
    columns = frames[0].columns
    before, after = [ordered(f.filter(F.col("timestamp") <= F.lit(cut)), *columns) for f in frames]
    assert before and before == after
