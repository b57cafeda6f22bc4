"""Alert events, suppression, and the alert stream batch by batch."""

import pytest
from pyspark.sql import functions as F

from pitflow.functions.shared import shared_folder
from pitflow.operators.alerts import alerts, alerts_of_all_windows, crossings, for_chats, latest_signal, not_yet_sent
from pitflow.operators.signals import generate_signals
from pitflow.schemas import ALERT, SUBSCRIPTION
from pitflow.sources.tables import read_batches
from pitflow.streaming.alerts import AlertTables, alert_batch
from tests.helpers import at, plus


def signals(spark, *rows):
    return spark.createDataFrame(
        rows, "ticker string, timestamp timestamp, entry_signal boolean, exit_signal boolean"
    )


def chats(spark, *rows):
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], SUBSCRIPTION)


SUBSCRIBED = (
    (1, "A", "1h", True), (2, "A", "1h", True), (3, "A", "4h", True), (4, "A", "1h", False), (5, "B", "1h", True),
)


def test_only_the_newest_bar_alerts(spark):
    rows = [("A", at("10:00"), True, False), ("A", at("11:00"), False, True), ("B", at("10:00"), True, False), ("B", at("11:00"), False, False)]
    frame = signals(spark, *rows)
    due = alerts(frame, chats(spark, *SUBSCRIBED))
    assert sorted((r.chat_id, r.kind, r.threshold) for r in due.collect()) == [(1, "exit", -0.2), (2, "exit", -0.2)]
    earlier = alerts(frame, chats(spark, *SUBSCRIBED), as_of=at("10:30"))
    assert sorted((r.chat_id, r.kind) for r in earlier.collect()) == [(1, "entry"), (2, "entry"), (5, "entry")]
    assert latest_signal(frame).count() == 2


def test_entry_goes_before_exit(spark):
    found = crossings(signals(spark, ("A", at("10:00"), True, True))).collect()
    assert [(r.kind, r.threshold) for r in found] == [("entry", 0.4)]


def test_suppression_looks_at_the_very_bar(spark):
    due = alerts(signals(spark, ("A", at("10:00"), True, False)), chats(spark, *SUBSCRIBED))
    log = spark.createDataFrame(
        [(1, "A", at("10:00")), (2, "A", at("09:00"))], "chat_id long, ticker string, timestamp timestamp"
    )
    assert [r.chat_id for r in not_yet_sent(due, log).collect()] == [2]


def test_every_chat_of_a_popular_ticker_is_reached(spark):
    many = spark.range(1000).select(
        F.col("id").alias("chat_id"), F.lit("A").alias("ticker"), F.lit("1h").alias("window"), F.lit(True).alias("subscribed")
    )
    events = crossings(signals(spark, ("A", at("10:00"), True, False), ("A", at("11:00"), False, True)))
    assert for_chats(events, many).groupBy("chat_id").count().filter("count = 2").count() == 1000


VALUES = [0.1, 0.5, 0.3, 0.6, 0.7, -0.5, 0.5, -0.3]


@pytest.mark.parametrize("cuts", [(0, 8), (0, 3, 8), (0, 1, 2, 2, 5, 8)])
def test_batches_find_the_same_crossings_as_the_whole(spark, cuts):
    rows = [("A", plus("10:00", 60 * i), v) for i, v in enumerate(VALUES)]
    schema = "ticker string, timestamp timestamp, sentiment_roll_1h double"
    root = shared_folder(spark, "alerts")
    tables = AlertTables(f"{root}/log", f"{root}/last")
    subscribed = chats(spark, *SUBSCRIBED)
    for batch, (start, end) in enumerate(zip(cuts, cuts[1:])):
        for _ in range(2):  # each batch runs twice
            alert_batch(spark.createDataFrame(rows[start:end], schema), batch, lambda: subscribed, tables)
    logged = read_batches(spark, tables.log, ALERT)
    expected = for_chats(crossings(generate_signals(spark.createDataFrame(rows, schema))), subscribed)
    columns = ["chat_id", "ticker", "timestamp", "kind", "threshold"]
    as_rows = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert as_rows(logged) == as_rows(expected)


SCHEMA = "ticker string, timestamp timestamp, sentiment_roll_1h double"


def bar(hour, value, ticker="A"):
    return (ticker, plus("10:00", 60 * hour), value)


def run(spark, tables, batch, rows, subscribed, **options):
    alert_batch(spark.createDataFrame(rows, SCHEMA), batch, lambda: chats(spark, *subscribed), tables, **options)


def sent(spark, tables):
    rows = read_batches(spark, tables.log, ALERT).collect()
    return sorted((r.chat_id, (r.timestamp - at("10:00").replace(tzinfo=None)).total_seconds() // 3600, r.kind) for r in rows)


@pytest.fixture
def tables(spark):
    root = shared_folder(spark, "alerts")
    return AlertTables(f"{root}/log", f"{root}/last")


ONE = ((1, "A", "1h", True),)


def test_a_bar_sent_again_replaces_the_older_version(spark, tables):
    run(spark, tables, 0, [bar(0, 0.1), bar(1, 0.3)], ONE)
    run(spark, tables, 1, [bar(1, 0.5), bar(2, 0.6)], ONE)
    assert sent(spark, tables) == [(1, 1, "entry")]


def test_a_late_bar_takes_its_place(spark, tables):
    run(spark, tables, 0, [bar(0, 0.1), bar(4, 0.2)], ONE)
    run(spark, tables, 1, [bar(2, 0.7)], ONE)
    run(spark, tables, 2, [bar(5, 0.1), bar(-30, 0.9)], ONE)  # the last one is too old
    assert sent(spark, tables) == [(1, 2, "entry")]


def test_chats_are_read_in_each_batch_and_not_told_the_past(spark, tables):
    run(spark, tables, 0, [bar(0, 0.1), bar(1, 0.5)], ONE)
    new = (2, "A", "1h", True, plus("10:00", 150))
    run(spark, tables, 1, [bar(1, 0.5), bar(2, 0.1), bar(3, 0.6)], (*ONE, new))
    assert sent(spark, tables) == [(1, 1, "entry"), (1, 3, "entry"), (2, 3, "entry")]


def test_a_new_feed_goes_on_from_the_last_one(spark, tables):
    for batch, rows in enumerate([[bar(0, 0.1)], [bar(1, 0.2)], [bar(2, 0.3)]]):
        run(spark, tables, batch, rows, ONE)
    run(spark, tables, 0, [bar(3, 0.6)], ONE, feed="second")
    assert sent(spark, tables) == [(1, 3, "entry")]


def test_each_chat_at_its_own_window(spark):
    frames = {
        "1h": signals(spark, ("A", at("10:00"), True, False)),
        "4h": signals(spark, ("A", at("08:00"), False, True)),
        "24h": signals(spark, ("A", at("00:00"), False, False)),
    }
    due = alerts_of_all_windows(frames, chats(spark, *SUBSCRIBED, (6, "A", "24h", True)))
    assert sorted((r.chat_id, r.kind) for r in due.collect()) == [(1, "entry"), (2, "entry"), (3, "exit")]
