"""Time cells: how one ticker's series is spread over many tasks.

A window over ``partitionBy("ticker")`` puts a whole ticker into one task, and
one ticker may hold a third of all rows. So every ordered step here works in
two levels:

1. inside a *cell*, the rows of one ticker within one fixed stretch of time;
2. over one carry row per (ticker, cell), ordered by cell.

A ticker has at most ``span / cell`` carry rows (522 for ten years of weekly
cells) no matter how many rows its cells hold, which is what makes the second
level safe to run per ticker. Shorter cells spread a dense series further.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.functions.durations import duration_us

CELL = "_cell"
US = "_us"
DEFAULT_CELL = "7d"


def cell_start(us: Column, width: int) -> Column:
    return us - F.pmod(us, F.lit(width))


def placed(df: DataFrame) -> DataFrame:
    """Rows without ticker or timestamp belong to no series and go. Saying so
    also gives every branch of a plan the same filter, which Spark needs to see
    that two branches read the same shuffle."""
    return df.filter("ticker is not null and timestamp is not null")


def with_cells(df: DataFrame, cell: str = DEFAULT_CELL, overlap_us: int = 0) -> DataFrame:
    """Adds ``_cell``, and ``_us`` in place of the timestamp. With an overlap, a
    row is also copied into the later cells that start at most ``overlap_us``
    after it.

    With one time column instead of two, branches of a plan that order by it
    and branches that output it need the same columns of a shuffle, and Spark
    runs that shuffle once."""
    width = duration_us(cell)
    df = placed(df).withColumn(US, F.unix_micros("timestamp")).drop("timestamp")
    home = cell_start(F.col(US), width)
    if not overlap_us:
        return df.withColumn(CELL, home)
    last = cell_start(F.col(US) + F.lit(overlap_us), width)
    return df.withColumn(CELL, F.explode(F.sequence(home, last, F.lit(width))))


def leave_cells(df: DataFrame) -> DataFrame:
    """Back to a timestamp, without the cell columns."""
    rest = [c for c in df.columns if c not in ("ticker", CELL, US)]
    return df.select("ticker", F.timestamp_micros(US).alias("timestamp"), *rest)


def is_home(cell: str) -> Column:
    """True for the row itself, false for its copies in later cells."""
    return F.col(US) >= F.col(CELL)


def in_cell(*order: str):
    return Window.partitionBy("ticker", CELL).orderBy(US, *order)


def over_cells():
    return Window.partitionBy("ticker").orderBy(CELL)


def before_cell():
    return over_cells().rowsBetween(Window.unboundedPreceding, -1)
