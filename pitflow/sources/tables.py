"""Keyed Parquet tables that stay right when a batch is written again.

A table is a folder of batches, ``feed=<name>/batch_id=<n>``, each partitioned
by date and ticker inside. Writing a batch replaces that batch's folder and
nothing else, so a replay (the same rows, fewer, or none) leaves exactly what
the last attempt wrote. An upsert only appends; ``current`` resolves each key
to its newest batch. ``compact`` writes the resolved rows to a fresh table,
which bounds how much a read has to resolve.

A feed is one checkpoint's run of batch ids. A stream restarted without its
checkpoint counts from 0 again and needs a new feed, later in ``feeds``.
"""

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitflow.operators.keyed import latest_per_key
from pitflow.sources.posts import with_date

PARTITIONS = ("date", "ticker")
POST_KEY = ("id",)
# The date follows from the timestamp, so it may be part of the key, and date
# filters then reach the scan through the latest-per-key step.
BAR_KEY = ("ticker", "timestamp", "date")
DEFAULT_FEED = "main"


def batch_path(root: str, batch_id: int, feed: str = DEFAULT_FEED) -> str:
    return f"{root}/feed={feed}/batch_id={batch_id}"


def _by_content(df: DataFrame, *known: str) -> list[Column]:
    """All other columns, newest timestamp first: which row counts must not
    depend on the order in which rows arrive."""
    names = [n for n, kind in df.dtypes if n not in known and "map<" not in kind and kind != "variant"]
    return [F.col(n).desc() for n in sorted(names, key=lambda n: (n != "timestamp", n))]


def write_batch(
    df: DataFrame,
    root: str,
    batch_id: int = 0,
    feed: str = DEFAULT_FEED,
    observation: Observation | None = None,
    key: Sequence[str] | None = None,
    partitions: Sequence[str] = PARTITIONS,
    gather: bool = True,
    codec: str | None = None,
) -> None:
    """Writes or replaces one batch. An empty one is written too: it clears
    what an earlier attempt left. With ``key``, of several rows with one key
    only the later and then the greater one is written.

    The rebalance hint gathers the rows of a date and ticker into few files and
    still splits a date and ticker that is too big for one task; ``gather`` is false
    for rows that are gathered already. Pass an ``Observation`` to get the row count
    out of the same job. ``codec`` is one of Parquet's, the session's by default."""
    df = with_date(df)
    if key is not None:
        df = latest_per_key(df, list(key), _by_content(df, *key))
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows"))
    (
        (df.hint("rebalance", *partitions) if gather else df)
        .write.mode("overwrite")
        .partitionBy(*partitions)
        .parquet(batch_path(root, batch_id, feed), compression=codec)
    )


def observed_rows(observation: Observation) -> int:
    """The rows that a write counted. Spark leaves the write's own counting out where
    it finds that there is nothing to write; the metrics are then missing."""
    try:
        return observation.get["rows"]
    except Py4JJavaError:
        return 0


def table_schema(row: T.StructType) -> T.StructType:
    """Explicit types for reading: inferred ones would turn a ticker that looks
    like a number into one."""
    fields = [f for f in row.fields if f.name not in PARTITIONS]
    return T.StructType(
        fields
        + [
            T.StructField("feed", T.StringType()),
            T.StructField("batch_id", T.LongType()),
            T.StructField("date", T.DateType()),
            T.StructField("ticker", T.StringType()),
        ]
    )


def read_path(
    spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = False
) -> DataFrame:
    """Parquet under ``path``. Where nothing was written, an error, or no rows
    for a caller that expects as much: a mistyped path must not read as empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_batches(
    spark: SparkSession,
    root: str,
    row: T.StructType,
    upto_batch: int | None = None,
    missing_ok: bool = False,
) -> DataFrame:
    """All rows of all batches. Files without a later-added column give nulls."""
    batches = read_path(spark, root, table_schema(row), missing_ok)
    if upto_batch is not None:
        batches = batches.filter(F.col("batch_id") <= upto_batch)
    return batches


def read_batch(
    spark: SparkSession, root: str, row: T.StructType, batch_id: int = 0, feed: str = DEFAULT_FEED
) -> DataFrame:
    """The rows of one batch, a task's rows from as few dates and tickers as its files."""
    fields = [f for f in table_schema(row).fields if f.name not in ("feed", "batch_id")]
    return read_path(spark, batch_path(root, batch_id, feed), T.StructType(fields)).select(*row.names)


PROGRESS = T.StructType([T.StructField("finished_at", T.TimestampType())])
BATCH_FIELDS = [T.StructField("feed", T.StringType()), T.StructField("batch_id", T.LongType())]


def mark_started(spark: SparkSession, root: str, batch_id: int, feed: str = DEFAULT_FEED) -> None:
    """Hides a batch from ``finished_batches`` while its folders are replaced."""
    spark.createDataFrame([], PROGRESS).write.mode("overwrite").parquet(batch_path(root, batch_id, feed))


def mark_finished(spark: SparkSession, root: str, batch_id: int, feed: str = DEFAULT_FEED) -> None:
    now = spark.range(1).select(F.current_timestamp().alias("finished_at")).coalesce(1)
    now.write.mode("overwrite").parquet(batch_path(root, batch_id, feed))


def finished_batches(batches: DataFrame, progress: str) -> DataFrame:
    """The rows of batches whose job came to its end; ``progress`` is the folder
    the job marks them in. A reader beside a running stream sees whole batches
    only, and none while it is written once more."""
    schema = T.StructType(PROGRESS.fields + BATCH_FIELDS)
    done = read_path(batches.sparkSession, progress, schema, missing_ok=True)
    return batches.join(done.select("feed", "batch_id"), ["feed", "batch_id"], "left_semi")


def over_base(base: DataFrame, later: DataFrame, key: Sequence[str]) -> DataFrame:
    """Current rows of a compacted base and of the batches after it, both with
    one row per key. Only keys of the later rows, which are few, meet the base;
    its rows keep their order and partitions."""
    names = [c for c in base.columns if c not in ("feed", "batch_id")]
    untouched = base.join(later.select(*key), list(key), "left_anti")
    return untouched.select(*names).unionByName(later.select(*names))


def current(batches: DataFrame, key: Sequence[str], feeds: Sequence[str] = (DEFAULT_FEED,)) -> DataFrame:
    """The newest version of each key: last feed, then last batch. A batch holds
    a key once if it was written with ``key``. ``feeds`` has to name every feed
    of the table, oldest first; an unnamed one is an error.

    Filter on key columns before or after, as Spark pushes those. Filter on
    anything else only afterwards: an older version of a row that moved would
    come back otherwise."""
    order = F.lit(0)
    if "feed" in batches.columns:
        order = F.raise_error(F.concat(F.lit("feed not in feeds: "), F.col("feed"))).cast("int")
        for position, feed in enumerate(feeds):
            order = F.when(F.col("feed") == feed, position).otherwise(order)
    newest: list[Column] = [order.desc(), F.col("batch_id").desc()]
    return latest_per_key(batches, list(key), newest)


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """``source`` rows replace ``target`` rows of the same key, others are added.
    Of several source rows with one key, the later and then the greater counts."""
    both = target.withColumn("batch_id", F.lit(0)).unionByName(source.withColumn("batch_id", F.lit(1)))
    newest = [F.col("batch_id").desc(), *_by_content(both, *key, "batch_id")]
    return latest_per_key(both, list(key), newest).drop("batch_id")


def compact(
    rows: DataFrame,
    root: str,
    cluster_by: Sequence[str] | None = None,
    files: int | None = None,
    batch_id: int = 0,
    feed: str = DEFAULT_FEED,
) -> None:
    """Rewrites resolved rows into a new table with few, sorted files.

    Range partitioning cuts by row counts, so a hot date or ticker gets
    several files and a small one shares a task. ``cluster_by`` adds columns
    to sort on, for min/max skipping inside the files."""
    rows = with_date(rows.drop("feed", "batch_id"))
    columns = [*PARTITIONS, *(cluster_by or ("timestamp",))]
    ranged = (
        rows.repartitionByRange(files, *columns) if files else rows.repartitionByRange(*columns)
    )
    (
        ranged.sortWithinPartitions(*columns)
        .write.mode("overwrite")
        .partitionBy(*PARTITIONS)
        .parquet(batch_path(root, batch_id, feed))
    )
