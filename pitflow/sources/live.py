"""A table that streams write and others read, with a bounded number of folders.

A live table is a folder of batches, as in ``tables``, and a base into which
finished batches are folded. Each fold writes a new generation of the base and
says up to which batch of each feed it reaches. A reader takes the newest
generation that is whole, and the finished batches after it; what the last two
generations do not need any more is deleted. A reader that began with the
generation before the newest can end in peace.

Folding takes only batches that cannot run again: those before the one that the
stream is at. So a batch that runs twice is replaced, never counted twice.
"""

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitflow.sources.posts import with_date
from pitflow.sources.tables import (
    BATCH_FIELDS,
    DEFAULT_FEED,
    PROGRESS,
    batch_path,
    current,
    mark_finished,
    mark_started,
    read_path,
    write_batch,
)

#: Batches of a feed after which its stream folds them.
FOLD_EVERY = 20
#: Folders are by date only: a batch with very many tickers has no folder for each.
BY_DATE = ("date",)

POSITION = T.StructType(
    [T.StructField("upto_feed", T.StringType()), T.StructField("upto_batch", T.LongType())]
)


@dataclass(frozen=True)
class LiveTable:
    """``row`` is the type of what is written; ``resolve`` turns the rows of many
    batches, with their feed and batch_id, into those that count now. Its result has
    the same columns and may be resolved again together with later batches."""

    root: str
    row: T.StructType
    resolve: Callable[[DataFrame], DataFrame]

    @property
    def batches(self) -> str:
        return f"{self.root}/batches"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    def base(self, generation: int) -> str:
        return f"{self.root}/base/generation={generation}"

    @property
    def columns(self) -> list[str]:
        return [*self.row.names, "feed", "batch_id"]

    # --- writing -----------------------------------------------------------

    def write(
        self,
        rows: DataFrame,
        batch_id: int,
        feed: str = DEFAULT_FEED,
        observation: Observation | None = None,
        key: Sequence[str] | None = None,
    ) -> None:
        """Writes or replaces one batch; readers see it once it is whole. With
        ``key``, of several rows with one key only the greatest is written."""
        spark = rows.sparkSession
        mark_started(spark, self.progress, batch_id, feed)
        chosen = rows.select(*self.row.names)
        write_batch(chosen, self.batches, batch_id, feed, observation, key, partitions=BY_DATE)
        mark_finished(spark, self.progress, batch_id, feed)

    def take(
        self,
        rows: DataFrame,
        batch_id: int,
        feed: str = DEFAULT_FEED,
        fold_every: int = FOLD_EVERY,
        observation: Observation | None = None,
    ) -> None:
        """A stream's batch: written, and from time to time the earlier ones folded."""
        self.write(rows, batch_id, feed, observation)
        self.fold_now_and_then(rows.sparkSession, batch_id, feed, fold_every)

    def fold_now_and_then(
        self, spark: SparkSession, batch_id: int, feed: str = DEFAULT_FEED, fold_every: int = FOLD_EVERY
    ) -> None:
        if batch_id and batch_id % fold_every == 0:
            self.fold(spark, {feed: batch_id})

    # --- reading -----------------------------------------------------------

    def generations(self, spark: SparkSession) -> list[int]:
        """Numbers of the whole generations, falling."""
        known = read_path(spark, f"{self.root}/position", _keyed(POSITION, "generation"), missing_ok=True)
        return sorted((r[0] for r in known.select("generation").distinct().collect()), reverse=True)

    def position(self, spark: SparkSession, generation: int | None) -> dict[str, int]:
        """The last folded batch of each feed: a row per feed."""
        if generation is None:
            return {}
        rows = read_path(spark, f"{self.root}/position/generation={generation}", POSITION)
        return {r.upto_feed: r.upto_batch for r in rows.filter("upto_feed is not null").collect()}

    def finished(self, spark: SparkSession) -> list[tuple[str, int]]:
        """Whole batches that are still there: those after the folded ones and some more."""
        done = read_path(spark, self.progress, T.StructType(PROGRESS.fields + BATCH_FIELDS), missing_ok=True)
        return sorted((r.feed, r.batch_id) for r in done.select("feed", "batch_id").collect())

    def rows(self, spark: SparkSession) -> DataFrame:
        """The base and the finished batches after it, not resolved. Only their
        folders are listed, so a read does not slow down with the table's age."""
        newest = next(iter(self.generations(spark)), None)
        folded = self.position(spark, newest)
        later = [(f, b) for f, b in self.finished(spark) if b > folded.get(f, -1)]
        return self._read(spark, newest, later)

    def current(self, spark: SparkSession) -> DataFrame:
        """What counts now."""
        return self.resolve(self.rows(spark)).select(*self.row.names)

    def _read(self, spark: SparkSession, generation: int | None, batches: Sequence[tuple[str, int]]) -> DataFrame:
        dated = T.StructField("date", T.DateType())
        parts = []
        if generation is not None:
            schema = T.StructType(self.row.fields + BATCH_FIELDS + [dated])
            parts.append(read_path(spark, self.base(generation), schema))
        if batches:
            schema = T.StructType(self.row.fields + BATCH_FIELDS + [dated])
            paths = [batch_path(self.batches, b, f) for f, b in batches]
            reader = spark.read.schema(schema).option("basePath", self.batches)
            parts.append(reader.parquet(*paths))
        if not parts:
            return spark.createDataFrame([], T.StructType(self.row.fields + BATCH_FIELDS))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.select(*self.columns)

    # --- folding -----------------------------------------------------------

    def fold(self, spark: SparkSession, before: Mapping[str, int]) -> None:
        """Folds the finished batches of the feeds in ``before``, up to but without
        the batch named there. One job at a time may fold a table."""
        generations = self.generations(spark)
        newest = generations[0] if generations else None
        folded = self.position(spark, newest)
        taken = [(f, b) for f, b in self.finished(spark) if folded.get(f, -1) < b < before.get(f, 0)]
        if not taken:
            return
        generation = (newest or 0) + 1
        resolved = with_date(self.resolve(self._read(spark, newest, taken)).select(*self.columns))
        keys = [c for c in ("date", "ticker", "timestamp") if c in resolved.columns]
        # Cut by row counts, so a hot ticker gets several files, sorted for min/max skipping.
        ordered = resolved.repartitionByRange(*keys).sortWithinPartitions(*keys)
        ordered.write.mode("overwrite").partitionBy("date").parquet(self.base(generation))
        reached = {**folded, **{f: max(b for g, b in taken if g == f) for f, _ in taken}}
        at = spark.createDataFrame(list(reached.items()), POSITION).coalesce(1)
        # The generation counts from here on.
        at.write.mode("overwrite").parquet(f"{self.root}/position/generation={generation}")
        self._retire(spark, generations, folded)

    def _retire(self, spark: SparkSession, earlier: Sequence[int], folded: Mapping[str, int]) -> None:
        """Deletes generations before the last two, and the batches that the last but
        one had already folded."""
        for generation in earlier[1:]:
            _delete(spark, f"{self.root}/position/generation={generation}")
            _delete(spark, self.base(generation))
        for feed, batch_id in self.finished(spark):
            if batch_id <= folded.get(feed, -1):
                _delete(spark, batch_path(self.progress, batch_id, feed))
                _delete(spark, batch_path(self.batches, batch_id, feed))


def _keyed(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField(name, T.IntegerType())])


def _delete(spark: SparkSession, path: str) -> None:
    """Through Spark's file system, wherever the table is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def keyed_table(
    root: str, row: T.StructType, key: Sequence[str], feeds: Sequence[str] = (DEFAULT_FEED,)
) -> LiveTable:
    """The newest version of each key counts: last feed, then last batch."""
    return LiveTable(root, row, lambda rows: current(rows, key, feeds))
