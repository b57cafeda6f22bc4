"""Weighted medians per key by radix selection.

Values are counted by their leading bits; the counts of one key, a bounded
number, say which leading bits its median has; only values with those bits are
counted by their next bits, until none are left. No task ever puts the values
of a key in order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a value that one round looks at, and the rounds: values are below 2^57.
ROUND_BITS, ROUNDS = 19, 3


def _passed(counts: Column, rank: Column) -> Column:
    """Of (bucket, n) in order of bucket, the bucket in which the running sum reaches
    ``rank``, and the sum before it."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("upto"), none.alias("bucket"), none.alias("before"))

    def step(seen: Column, part: Column) -> Column:
        upto = seen["upto"] + part["n"]
        here = seen["bucket"].isNull() & (upto >= rank)
        return F.struct(
            upto.alias("upto"),
            F.when(here, part["bucket"]).otherwise(seen["bucket"]).alias("bucket"),
            F.when(here, seen["upto"]).otherwise(seen["before"]).alias("before"),
        )

    return F.aggregate(F.array_sort(counts), start, step)


def weighted_median(rows: DataFrame, key: Sequence[str], value: str, weight: str, name: str) -> DataFrame:
    """``key`` and ``name``, the median of ``value``, a whole number from 0 on, each
    counted ``weight`` times; the mean of the two middle ones of an even number.
    Nulls and negative values are left out, and so are keys without any other."""
    counted = rows.filter(F.col(value) >= 0).select(
        *key, F.col(value).alias("_value"), F.col(weight).cast("long").alias("_weight")
    )
    state = None
    for done in range(ROUNDS):
        shift = ROUND_BITS * (ROUNDS - 1 - done)
        bucket = F.shiftright("_value", shift).alias("bucket")
        if state is None:
            # Both middle ranks start from the same counts.
            histogram = counted.groupBy(*key, bucket).agg(F.sum("_weight").alias("n"))
            ranks = F.array(F.expr("(total + 1) div 2"), F.expr("total div 2 + 1"))
            lists = histogram.groupBy(*key).agg(
                F.collect_list(F.struct("bucket", "n")).alias("counts"), F.sum("n").alias("total")
            )
            lists = lists.select(*key, "counts", F.posexplode(ranks).alias("_half", "rank"))
        else:
            inside = counted.withColumn("prefix", F.shiftright("_value", shift + ROUND_BITS))
            histogram = (
                inside.join(state, [*key, "prefix"])
                .groupBy(*key, "_half", "rank", bucket)
                .agg(F.sum("_weight").alias("n"))
            )
            lists = histogram.groupBy(*key, "_half", "rank").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
        found = lists.withColumn("found", _passed(F.col("counts"), F.col("rank")))
        state = found.select(
            *key,
            "_half",
            F.col("found.bucket").alias("prefix"),
            (F.col("rank") - F.col("found.before")).alias("rank"),
        )
    return state.groupBy(*key).agg(F.avg("prefix").alias(name))
