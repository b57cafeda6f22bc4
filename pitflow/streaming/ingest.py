"""Bus records to the raw and the scored post table, batch by batch."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pitflow.operators.sentiment import dedupe_posts
from pitflow.schemas import RAW_FIELDS, RAW_POST, TRIGGER, WATERMARK
from pitflow.sources.posts import with_reject_reason
from pitflow.sources.tables import (
    DEFAULT_FEED,
    batch_path,
    mark_finished,
    mark_started,
    observed_rows,
    read_batch,
    write_batch,
)

#: Texts take about two thirds of the space they take with snappy, Spark's default; an
#: executor that scored in place, many files a task, was at 3.6 GB with that, at 2.4 with this.
CODEC = "zstd"

#: Called with a batch's number and the rows written to each table.
Report = Callable[[int, dict[str, int]], None]


@dataclass(frozen=True)
class PostTables:
    raw: str
    scored: str
    rejected: str
    progress: str


def ingest_batch(
    records: DataFrame,
    batch_id: int,
    tables: PostTables,
    score: Callable[[DataFrame], DataFrame],
    feed: str = DEFAULT_FEED,
    report: Report | None = None,
    in_place: bool = False,
) -> None:
    """Every table gets this batch's folder replaced, so running a batch again
    changes nothing; readers of ``finished_batches`` see it before or after, not
    in between. Records are read and parsed once, the model sees each post
    once, and an empty batch never reaches it. ``report`` gets the batch's number and
    how many rows went to each table, counted by the writes themselves.

    Posts reach the model spread by id, and each table gathers its rows by date and
    ticker. With ``in_place`` they are gathered once, for the raw table, and scored
    from its files as they lie: for a ``score`` that costs little and moves no rows
    between tasks."""
    checked = with_reject_reason(records)
    # The value holds the text once more; only of rejected records it is wanted.
    checked = checked.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value"))).persist()
    posts = dedupe_posts(checked.filter("reason is null").select(*RAW_FIELDS))
    spark = records.sparkSession
    if not in_place:
        posts.persist()
    mark_started(spark, tables.progress, batch_id, feed)
    seen = {name: Observation(f"{name} of {feed} {batch_id}") for name in ("rejected", "raw", "scored")}
    try:
        rejected = checked.filter("reason is not null").select("value", "reason")
        rejected = rejected.observe(seen["rejected"], F.count(F.lit(1)).alias("rows"))
        rejected.write.mode("overwrite").parquet(batch_path(tables.rejected, batch_id, feed), compression=CODEC)
        write_batch(posts, tables.raw, batch_id, feed, seen["raw"], codec=CODEC)
        stored = read_batch(spark, tables.raw, RAW_POST, batch_id, feed) if in_place else posts
        scored = score(stored)
        write_batch(scored, tables.scored, batch_id, feed, seen["scored"], gather=not in_place, codec=CODEC)
        mark_finished(spark, tables.progress, batch_id, feed)
        if report is not None:
            report(batch_id, {name: observed_rows(observation) for name, observation in seen.items()})
    finally:
        posts.unpersist()
        checked.unpersist()


def start_ingest(
    records: DataFrame,
    tables: PostTables,
    score: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    trigger: dict | None = None,
    feed: str = DEFAULT_FEED,
    report: Report | None = None,
    in_place: bool = False,
) -> StreamingQuery:
    """``records`` is a stream with a ``value`` column. The number of records
    per batch shows in the query's progress as ``records``."""
    counted = records.observe("records", F.count(F.lit(1)).alias("rows"))
    return (
        counted.writeStream.foreachBatch(
            lambda batch, batch_id: ingest_batch(batch, batch_id, tables, score, feed, report, in_place)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )


def dedupe_stream(posts: DataFrame, watermark: str | None = WATERMARK) -> DataFrame:
    """One row per id across batches, as long as copies arrive within the watermark;
    with ``watermark`` None, however late they arrive. Then the state has every id
    ever seen: start the query by ``with_rocks``, so that it is on the executors'
    disks, where the store's own Bloom filters spare most look-ups of new ids."""
    if watermark is None:
        return posts.dropDuplicates(["id"])
    return posts.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["id"])
