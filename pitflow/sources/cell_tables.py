"""Series stored by (ticker, cell), for steps that would shuffle by it.

A cell table is a table of Spark's own, bucketed by (ticker, cell) and written
with its overlap copies. As-of joins, rolling means and signals over such a table
start from the scan, without a shuffle of its rows (``plans.research.StoredSeries``). Rows sent again are told apart by their
version; the newest one counts, found within its bucket.

Choose ``groups`` for the table's final size, some hundred megabytes a group: it
is fixed when the table is made. Series that are to meet belong in one table, told
apart by a column of the key: Spark forgets the partitioning of two bucketed tables
at their union as soon as anything stands between scan and union.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitflow.functions.cells import CELL, DEFAULT_CELL, US, with_cells
from pitflow.functions.durations import duration_us
from pitflow.operators.keyed import latest_per_key

VERSION = "_version"
GROUPS = 64


@dataclass(frozen=True)
class CellTable:
    """``name`` is the table's in the session's catalog, ``path`` its folder, which
    executors share, and ``row`` the type of its rows (ticker, timestamp, others).
    A row is copied into the cells that start at most ``overlap`` after it. Rows are
    told apart by ticker, timestamp and the columns ``also``."""

    name: str
    path: str
    row: T.StructType
    cell: str = DEFAULT_CELL
    overlap: str | None = None
    groups: int = GROUPS
    also: tuple[str, ...] = ()

    @property
    def overlap_us(self) -> int:
        return duration_us(self.overlap) if self.overlap else 0

    @property
    def stored(self) -> T.StructType:
        others = [f for f in self.row.fields if f.name not in ("ticker", "timestamp")]
        keys = [T.StructField("ticker", T.StringType())]
        keys += [T.StructField(n, T.LongType()) for n in (CELL, US, VERSION)]
        return T.StructType(keys + others)

    def attach(self, spark: SparkSession) -> "CellTable":
        """Makes the table known to a session, and new if there is none."""
        path = self.path.replace("'", "\\'")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.stored.fields)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet "
            f"CLUSTERED BY (ticker, {CELL}) SORTED BY (ticker, {CELL}, {US}) "
            f"INTO {self.groups} BUCKETS LOCATION '{path}'"
        )
        return self

    def add(self, rows: DataFrame, version: int) -> None:
        """Adds rows; those without ticker or timestamp are left out. Of rows with
        one key that of the greatest version counts, so a version that runs again
        changes nothing. Within a version keys must be unique."""
        spark = rows.sparkSession
        placed = with_cells(rows.select(*self.row.names), self.cell, self.overlap_us)
        placed = placed.withColumn(VERSION, F.lit(version).cast("long"))
        # One file a group, as Spark puts rows into buckets by the hash it shuffles by.
        grouped = placed.select(*self.stored.names).repartition(self.groups, "ticker", CELL)
        self.attach(spark)
        grouped.write.insertInto(self.name)

    def _newest(self, spark: SparkSession) -> DataFrame:
        self.attach(spark)
        keys = ["ticker", CELL, US, *self.also]
        return latest_per_key(spark.table(self.name), keys, [F.col(VERSION).desc()])

    def rows(self, spark: SparkSession) -> DataFrame:
        """What counts now, in cells, overlap copies included, hashed by (ticker, cell)."""
        return self._newest(spark).drop(VERSION)

    def fold(self, spark: SparkSession, name: str, path: str) -> "CellTable":
        """A new table of what counts now, one file a group. Versions stay, so later ones
        may follow in the new table. Rows are in their groups already and are not shuffled.
        The old folder is the caller's to delete, when no reader needs it any more."""
        folded = replace(self, name=name, path=path).attach(spark)
        self._newest(spark).select(*self.stored.names).write.insertInto(name, overwrite=True)
        return folded
