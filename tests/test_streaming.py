"""The streams against their batch twins, on files arriving one at a time."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pitflow.functions.shared import shared_folder
from pitflow.operators.scoring import score_texts
from pitflow.operators.sentiment import aggregate_sentiment
from pitflow.schemas import BUCKET, BUCKET_WINDOW, RAW_POST, REJECTED_POST, SCORED_POST
from pitflow.sources.posts import read_post_stream
from pitflow.sources.tables import BAR_KEY, POST_KEY, current, finished_batches, read_batches
from pitflow.streaming.buckets import bucket_stream, start_bucket_table
from pitflow.streaming.ingest import PostTables, dedupe_stream, ingest_batch, start_ingest
from tests.helpers import ordered, plus, scored

ONCE = {"availableNow": True}


def value(i, ticker="A", text="the cat", minute=0):
    stamp = plus("10:00", minute).isoformat()
    return json.dumps({"id": str(i), "ticker": ticker, "timestamp": stamp, "source": "news", "text": text})


def lexicon(df):
    return score_texts(df, ["the"], ["and"])


def write_values(spark, path, values):
    frame = spark.createDataFrame([(v,) for v in values], "value string")
    frame.select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary")).coalesce(1).write.mode(
        "append"
    ).parquet(path)


@pytest.fixture
def tables(spark):
    root = shared_folder(spark, "ingest")
    return PostTables(f"{root}/raw", f"{root}/scored", f"{root}/rejected", f"{root}/progress")


def stored(spark, root, schema):
    return current(read_batches(spark, root, schema), POST_KEY)


def test_ingest_over_several_runs(spark, tables):
    source, checkpoint = shared_folder(spark, "bus"), shared_folder(spark, "checkpoint")
    batches = [[value(1), value(1), value(2, "B"), "{bad"], [value(2, "B", "and dog", 60 * 24 * 3), value(3)], [value(3)]]
    progress = []
    for batch in batches:
        write_values(spark, source, batch)
        query = start_ingest(read_post_stream(spark, "parquet", source), tables, lexicon, checkpoint, ONCE)
        query.awaitTermination()
        progress.append(query.lastProgress)
    raw = stored(spark, tables.raw, RAW_POST)
    assert sorted(r.id for r in raw.collect()) == ["1", "2", "3"]
    found = {r.id: r for r in stored(spark, tables.scored, SCORED_POST).collect()}
    assert found["2"].text == "and dog" and found["2"].sentiment_score < 0 < found["3"].sentiment_score
    rejects = spark.read.schema(REJECTED_POST).parquet(tables.rejected)
    assert [(r.value, r.reason) for r in rejects.collect()] == [("{bad", "malformed")]
    assert [p.observedMetrics["records"].rows for p in progress] == [4, 2, 1]


def test_a_batch_run_again_changes_nothing(spark, tables):
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    ingest_batch(frame(value(1), value(2), "{bad"), 0, tables, lexicon)
    ingest_batch(frame(value(3), "{worse"), 1, tables, lexicon)
    ingest_batch(frame(value(3), "{worse"), 1, tables, lexicon)
    assert read_batches(spark, tables.raw, RAW_POST).count() == 3
    assert spark.read.schema(REJECTED_POST).parquet(tables.rejected).count() == 2
    ingest_batch(frame(), 1, tables, lexicon)
    assert read_batches(spark, tables.scored, SCORED_POST).count() == 2


def test_readers_see_finished_batches_only(spark, tables):
    frame = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    seen = lambda: finished_batches(read_batches(spark, tables.scored, SCORED_POST), tables.progress).count()
    ingest_batch(frame(value(1), value(2)), 0, tables, lexicon)
    during = []

    def watching(posts):
        during.append(seen())
        return lexicon(posts)

    ingest_batch(frame(value(3)), 1, tables, watching)
    assert seen() == 3
    ingest_batch(frame(value(3)), 1, tables, watching)  # the first batch stays visible, this one hides
    assert during == [2, 2] and seen() == 3

    def failing(posts):
        raise RuntimeError("model lost")

    with pytest.raises(RuntimeError):
        ingest_batch(frame(value(4)), 2, tables, failing)
    assert seen() == 3


def test_posts_scored_in_place(spark, tables):
    """The same tables as otherwise; a date and ticker too big for a task is split, and
    tickers may look like a number or a path."""
    known, folder = "spark.sql.adaptive.advisoryPartitionSizeInBytes", shared_folder(spark, "bus")
    words = F.concat_ws(" ", F.lit("the"), *(F.sha2(F.concat_ws("-", "id", F.lit(n)), 512) for n in range(20)))
    ticker = F.element_at(F.array(*map(F.lit, ("007", "a/b=c%", "1e5"))), F.greatest(F.lit(1), F.col("id") - 1998).cast("int"))
    fields = {"id": F.col("id").cast("string"), "ticker": ticker, "timestamp": F.lit("2024-01-02T10:00:00Z"), "source": F.lit("web"), "text": words}
    posts = spark.range(2002).select(*(c.alias(n) for n, c in fields.items()))
    values = posts.select(F.to_json(F.struct("*")).alias("value"))
    bad = spark.createDataFrame([("{bad",), (value("late").replace("10:00", "never"),)], "value string")
    values.unionByName(values.limit(7)).unionByName(bad).write.parquet(folder)
    records, told = spark.read.parquet(folder), []
    before = spark.conf.get(known)
    spark.conf.set(known, "256k")
    try:
        for batch_id, in_place in enumerate((False, True, True)):
            ingest_batch(records, batch_id, tables, lexicon, report=lambda _, rows: told.append(rows), in_place=in_place)
        ingest_batch(records, 1, tables, lexicon, in_place=True)  # again
        ingest_batch(records.limit(0), 2, tables, lexicon, in_place=True)  # nothing is left of it
    finally:
        spark.conf.set(known, before)
    count = values.count()
    assert told == [{"rejected": 2, "raw": count, "scored": count}] * 3
    for root, row in ((tables.raw, RAW_POST), (tables.scored, SCORED_POST)):
        found = read_batches(spark, root, row)
        spread, placed = (found.filter(F.col("batch_id") == n).select(*row.names) for n in (0, 1))
        assert sorted(map(str, spread.collect())) == sorted(map(str, placed.collect()))
        assert placed.count() == placed.select("id").distinct().count() == count
        assert found.filter("batch_id = 2").count() == 0
        assert {r.ticker for r in placed.select("ticker").distinct().collect()} == {"007", "a/b=c%", "1e5"}
    raw = read_batches(spark, tables.raw, RAW_POST).filter("batch_id = 1 and ticker = '007'")
    assert raw.select(F.input_file_name()).distinct().count() > 1
    rejects = read_batches(spark, tables.rejected, REJECTED_POST).filter("batch_id < 2")
    assert sorted(r.reason for r in rejects.collect()) == ["bad timestamp", "bad timestamp", "malformed", "malformed"]
    assert all(r.value for r in rejects.collect())


def post_files(spark, groups):
    path = shared_folder(spark, "scored")
    for group in groups:
        scored(spark, group).coalesce(1).write.mode("append").parquet(path)
    return path


def run_to_table(stream, spark, mode):
    root = shared_folder(spark, "out")
    rows = []
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**ONCE)
        .foreachBatch(lambda df, _: rows.extend(df.collect()))
        .start()
    )
    query.awaitTermination()
    return rows


def test_bucket_stream_in_both_modes(spark):
    rows = [("A", plus("10:00", 7 * i), ((i * 13) % 20) / 10 - 1) for i in range(60)]
    path = post_files(spark, [rows[:20], rows[20:45], rows[45:]])
    posts = spark.read.parquet(path)
    read = lambda: spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    batch = {r.timestamp: r for r in aggregate_sentiment(posts).collect()}
    final = run_to_table(bucket_stream(read()), spark, "append")
    newest = max(r.timestamp for r in posts.collect())
    assert {r.timestamp for r in final} == {t for t in batch if (newest - t).total_seconds() >= 3600}
    latest = {r.timestamp: r for r in run_to_table(bucket_stream(read()), spark, "update")}
    assert latest.keys() == batch.keys()
    for stamp, row in latest.items():
        assert (row.post_count, row.avg_sentiment) == (batch[stamp].post_count, pytest.approx(batch[stamp].avg_sentiment))
    for row in final:
        assert row.avg_sentiment == pytest.approx(batch[row.timestamp].avg_sentiment)


def test_late_posts_miss_the_stream_but_not_the_batch(spark):
    on_time = [("A", plus("10:00", 60 * i), 0.5) for i in range(6)]
    late = [("A", plus("10:00", 1), -0.5)]
    path = shared_folder(spark, "late")
    scored(spark, on_time).coalesce(1).write.parquet(path)
    schema = spark.read.parquet(path).schema
    root = shared_folder(spark, "out")
    seen = []

    def run():
        stream = bucket_stream(spark.readStream.schema(schema).parquet(path))
        stream.writeStream.outputMode("update").option("checkpointLocation", root).trigger(**ONCE).foreachBatch(
            lambda df, _: seen.extend(df.collect())
        ).start().awaitTermination()

    run()
    scored(spark, late).coalesce(1).write.mode("append").parquet(path)
    run()
    first = plus("10:00", 15).replace(tzinfo=None)
    assert [r.post_count for r in seen if r.timestamp == first] == [1]
    rebuilt = aggregate_sentiment(spark.read.parquet(path))
    assert ordered(rebuilt, "timestamp", "post_count")[0] == (first, 2)


def test_dedupe_stream(spark):
    rows = [("A", plus("10:00", i % 5), 0.5) for i in range(20)]
    path = post_files(spark, [rows[:10], rows[10:]])
    schema = spark.read.parquet(path).schema
    stream = dedupe_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
    assert len(run_to_table(stream, spark, "append")) == 5


def test_kafka_options_pass_through(spark):
    """The connector is not on the class path here, so only its absence shows."""
    with pytest.raises(Exception, match="(?i)kafka"):
        read_post_stream(spark, "kafka", **{"kafka.bootstrap.servers": "nowhere:9092", "subscribe": "posts"})


def test_bucket_table_equals_the_batch_aggregate(spark):
    rows = [("A", plus("10:00", 7 * i), ((i * 13) % 20) / 10 - 1) for i in range(60)] + [(None, plus("10:00", 5), 1.0)]
    path = post_files(spark, [rows[:20], rows[20:45], rows[45:]])
    posts = spark.read.parquet(path)
    root = shared_folder(spark, "bucket-table")
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_bucket_table(stream, f"{root}/table", f"{root}/checkpoint", trigger=ONCE).awaitTermination()
    stored = current(read_batches(spark, f"{root}/table", BUCKET), BAR_KEY)
    columns = ("ticker", "timestamp", "post_count")
    assert ordered(stored, *columns) == ordered(aggregate_sentiment(posts), *columns)
    assert stored.filter("ticker is null").count() == 0


def test_stream_queries_take_rows_of_any_time(spark, tmp_path):
    """Rows before, between and after the bounds of the slices, and one without a time."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    shift = F.expr("make_interval(0, 0, 0, cast(event_id % 3 - 1 AS int) * 60)")
    ts = F.when(F.col("event_id") != F.lit(events.agg(F.min("event_id")).first()[0]), F.col("ts") + shift)
    moved = events.withColumn("ts", ts.cast(events.schema["ts"].dataType))
    moved.write.parquet(str(tmp_path / "events.parquet"))
    queries = entry.queries()
    posts = entry.Inputs(spark, str(tmp_path)).posts()
    assert posts.filter("timestamp < '2024-01-01'").count() > 50 < posts.filter("timestamp > '2024-02-01'").count()
    batch = entry.rounded(aggregate_sentiment(posts, BUCKET_WINDOW))
    table = queries["bucket_table"](spark, str(tmp_path))
    assert sorted(map(str, table.collect())) == sorted(map(str, batch.select(*table.columns).collect()))
    got = queries["dedupe_stream"](spark, str(tmp_path)).select("id").collect()
    dated = posts.filter("timestamp is not null").select("id").collect()
    assert {r.id for r in dated} <= {r.id for r in got} and len(got) <= posts.count()


@pytest.mark.parametrize("layout", ["file", "folder", "partitioned"])
def test_stream_queries_read_a_table_of_any_layout(spark, tmp_path, layout):
    """One file, a folder of files, and a folder with a column in its folders' names."""

    def store(frame, name, column):
        target = tmp_path / f"{name}.parquet"
        if layout == "partitioned":
            frame.write.partitionBy(column).parquet(str(target))
        elif layout == "folder":
            frame.repartition(3).write.parquet(str(target))
        else:
            frame.coalesce(1).write.parquet(str(tmp_path / "parts" / name))
            shutil.copy(next((tmp_path / "parts" / name).glob("part-*")), target)

    texts = [(i, "the cat" if i % 2 else "and dog", "en" if i % 3 else "de", "web", 7) for i in range(1, 104)]
    store(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"), "documents", "lang")
    times = [(i, plus("10:00", 10 * i).replace(tzinfo=None), i % 4, "click", 1.0, json.dumps({"k": i})) for i in range(40)]
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    store(spark.createDataFrame(times, schema), "events", "event_type")

    posts = entry.queries()["ingest_stream"](spark, str(tmp_path)).collect()
    assert sorted(int(r.id) for r in posts) == [i for i, *_ in texts if i % 50]
    assert all(r.ticker == ("en" if int(r.id) % 3 else "de") for r in posts)
    assert all((r.sentiment_score > 0) == bool(int(r.id) % 2) for r in posts)

    batch = aggregate_sentiment(entry.Inputs(spark, str(tmp_path)).posts())
    final = batch.filter(F.col("timestamp") <= F.lit(plus("10:00", 390)) - F.expr("interval 1 hour"))
    got = entry.queries()["bucket_stream"](spark, str(tmp_path))
    columns = ("ticker", "timestamp", "post_count")
    assert ordered(got, *columns) == ordered(final, *columns) != []
