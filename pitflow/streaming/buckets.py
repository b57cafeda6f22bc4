"""Sentiment buckets kept up to date by a stream."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pitflow.functions.cells import placed
from pitflow.operators.sentiment import bucket_aggregates, stamped_at_end, tumbling
from pitflow.schemas import BUCKET_WINDOW, TRIGGER, WATERMARK
from pitflow.sources.tables import BAR_KEY, DEFAULT_FEED, write_batch


def bucket_stream(
    scored: DataFrame, window: str = BUCKET_WINDOW, watermark: str = WATERMARK
) -> DataFrame:
    """The batch aggregate over a stream of scored posts. Written in update mode
    it shows open buckets as they grow, in append mode only final ones.

    Posts later than the watermark are left out here. They are in the tables,
    so the batch aggregate over the tables has them."""
    return stamped_at_end(
        placed(scored)
        .withWatermark("timestamp", watermark)
        .groupBy("ticker", tumbling(window).alias("window"))
        .agg(*bucket_aggregates())
    )


def start_bucket_table(
    scored: DataFrame,
    root: str,
    checkpoint: str,
    window: str = BUCKET_WINDOW,
    watermark: str = WATERMARK,
    trigger: dict | None = None,
    feed: str = DEFAULT_FEED,
) -> StreamingQuery:
    """Keeps a table of all buckets, open ones too: each batch upserts those
    that grew. ``current`` over the table is the batch aggregate of the posts
    within the watermark; later ones are left out, as in ``bucket_stream``."""
    return (
        bucket_stream(scored, window, watermark)
        .writeStream.outputMode("update")
        .foreachBatch(lambda grown, batch_id: write_batch(grown, root, batch_id, feed, key=BAR_KEY))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": TRIGGER}))
        .start()
    )
