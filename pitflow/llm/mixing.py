"""Mixing sources to target weights by hash-threshold histograms.

Only DataFrame functions. Every document has a 40-bit hash of its id, repeated
rows one each. A source
takes each of its documents a whole number of times, and once more those whose
hash lies below the source's threshold. The threshold is found without sorting:
sum words by source and hash bucket, find the bucket in which the running sum
passes the budget, and look into that one bucket with ten bits more, four times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.llm.common import WORD, cut

BITS, LEVELS = 10, 4
#: Sources whose states are broadcast at most, a row of some hundred bytes each.
FEW = 10_000
#: Parts of a source where there are more of them, and of the rows of one id.
SALTS, CELLS = 32, 256
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2


def position(text: Column) -> Column:
    """A 40-bit hash."""
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long")


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def repeated_ids(sizes: DataFrame) -> DataFrame | None:
    """(source, doc_id) that several rows share; None if there are none. Counted
    before the shuffle, so an id of very many rows is one row a task."""
    counts = sizes.groupBy(F.col("source").alias("again_source"), F.col("doc_id").alias("again_id")).count()
    again = cut(counts.where(F.col("count") > 1).drop("count"))
    return None if again.isEmpty() else again


def placed(rows: DataFrame, again: DataFrame | None) -> DataFrame:
    """Adds ``h``, the place of each of ``rows`` (source, doc_id, size and others)
    on the line that thresholds cut: the hash of its id or, if rows of its source
    share the id, of id, size and a number. A null id hashes as empty text.

    Which of the rows with equal id and size has which number makes no difference
    to what is taken. They are numbered in CELLS parts each, so that no task has to
    put all rows of an id in order.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    if again is None:
        return rows.withColumn("h", position(name))
    shared = F.col("source").eqNullSafe(F.col("again_source")) & F.col("doc_id").eqNullSafe(F.col("again_id"))
    alone = rows.join(again, shared, "left_anti").withColumn("h", position(name))
    key = ["source", "doc_id", "size"]
    many = rows.join(again, shared, "left_semi").withColumn("cell", F.monotonically_increasing_id() % CELLS)
    # Fixed before it is read twice: the parts must not change between counting and numbering.
    many = cut(many)
    ahead = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = many.groupBy(*key, "cell").count()
    first = counts.select(
        *(F.col(c).alias(f"first_{c}") for c in (*key, "cell")),
        F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("first"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in (*key, "cell")]
    inside = F.row_number().over(Window.partitionBy(*key, "cell").orderBy("cell")) - 1
    numbered = many.withColumn("number", inside).join(first, same)
    own = F.concat_ws("/", name, F.col("size"), F.col("number") + F.col("first"))
    return alone.unionByName(numbered.withColumn("h", position(own)).select(*alone.columns))


def sized(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, source, size, h) of every row, written once, and the repeated ids."""
    plain = cut(docs.select("doc_id", "source", word_count().alias("size")))
    again = repeated_ids(plain)
    return placed(plain, again) if again is None else cut(placed(plain, again)), again


def met(rows: DataFrame, source: Column, state: DataFrame, few: bool) -> DataFrame:
    """``rows`` with the row of ``state`` (src and others) for their source. Up to
    FEW sources are broadcast, so that rows stay where they are. More of them are
    joined by source and a salt, as one source may hold a third of all rows."""
    if few:
        return rows.join(F.broadcast(state), source.eqNullSafe(F.col("src")))
    salted = rows.withColumn("salt", F.floor(F.rand(0) * SALTS).cast("int"))
    each = state.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, source.eqNullSafe(F.col("src")) & (F.col("salt") == F.col("salt_of"))).drop("salt", "salt_of")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """One row per source: its words, target, and what is left for the threshold.

    Sources in code point order, null last, take the weights in turn. Handing
    the excess of full sources to the others by weight ends where every target
    is the lesser of its limit and weight x level. With sources ordered by
    limit / weight, the level is the largest of (all - limits before) /
    (weights from here on). One row per source: the windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1))
    per = per.withColumn("w", turn.cast("double"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - most * before) / after
    per = per.withColumn("level", level)
    target = F.least(F.lit(float(most)) * F.col("source_size"), F.col("w") * F.max("level").over(everything))
    per = per.withColumn("target", target)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    return per.select(
        F.col("source").alias("src"),
        "source_size",
        "target",
        whole.alias("whole"),
        (F.col("target") - whole * F.col("source_size")).alias("budget"),
    )


def thresholds(sizes: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """(src, source_size, target, whole, threshold): below it, documents are
    taken once more. Of the two edges around the budget the nearer one counts,
    so a source misses its target by half its boundary document at most."""
    state = plan.withColumns({"prefix": F.lit(0).cast("long"), "left": F.col("budget")})
    carried = ["src", "source_size", "target", "whole", "prefix", "left"]
    for level in range(LEVELS):
        shift = BITS * (LEVELS - level)
        inside = met(sizes, F.col("source"), state, few).where(F.shiftright("h", shift) == F.col("prefix"))
        histogram = inside.groupBy(
            *carried, F.shiftright("h", shift - BITS).alias("bucket")
        ).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("src").orderBy("bucket"))
        running = histogram.withColumn("upto", upto)
        # The first bucket that passes the budget; the last one if none does.
        first = F.min_by(
            F.struct("source_size", "target", "whole", "bucket", "upto", "words", "left"),
            F.struct(F.col("upto") <= F.col("left"), F.when(F.col("upto") <= F.col("left"), -F.col("bucket")).otherwise(F.col("bucket"))),
        )
        state = running.groupBy("src").agg(first.alias("b")).select(
            "src",
            "b.source_size",
            "b.target",
            "b.whole",
            F.col("b.bucket").alias("prefix"),
            (F.col("b.left") - (F.col("b.upto") - F.col("b.words"))).alias("left"),
            F.col("b.words").alias("words"),
        )
    nearer = F.col("words") - F.col("left") < F.col("left")
    return state.select(
        "src", "source_size", "target", "whole", (F.col("prefix") + nearer.cast("long")).alias("threshold")
    )


def planned(sizes: DataFrame, weights, share: float, most: float) -> tuple[DataFrame, bool]:
    """(src, source_size, target, whole, threshold), a row per source, written once,
    and whether they are few."""
    plan = cut(targets(sizes, weights, share, most))
    few = plan.count() <= FEW
    return cut(thresholds(sizes, plan, few)), few


def repeats_of(h: Column) -> Column:
    return F.col("whole") + (h < F.col("threshold")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words, repeats counted)
    and repeats for every row of ``docs`` (doc_id, text, source).

    Null texts have no words. Rows that repeat an id are taken one by one, rows
    without id too. A null source is a source. Empty tables give an empty mix;
    other columns are not read.
    """
    sizes, _ = sized(docs)
    plan, few = planned(sizes, weights, share, most)
    taken = met(sizes, F.col("source"), plan, few).withColumn("repeats", repeats_of(F.col("h")))
    return taken.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        "repeats",
    )


def mixed(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """The rows of ``docs`` themselves, each as often as the mix takes it.

    The thresholds, a row per source, come from a narrow pass over ids and word
    counts and are broadcast, so texts are filtered as they are read, neither
    sorted nor shuffled. Only where ids repeat, or sources are more than FEW, are
    texts joined with the repeated ids or the sources. Nulls and empty tables as
    in ``mix``; all columns come back, whatever their names.
    """
    sizes, again = sized(docs)
    plan, few = planned(sizes, weights, share, most)
    rows = docs.select(F.struct("*").alias("doc"), "doc_id", "source", word_count().alias("size"))
    taken = met(placed(rows, again), F.col("source"), plan, few)
    copies = F.explode(F.array_repeat(F.lit(True), repeats_of(F.col("h")).cast("int")))
    return taken.select("doc", copies.alias("copy")).select("doc.*")


ORACLE = r"""
WITH r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         count(*) OVER (PARTITION BY source, doc_id) AS again
  FROM {docs}),
n AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id, size) - 1 AS number FROM r),
d AS (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')
                || CASE WHEN again > 1 THEN '/' || size || '/' || number ELSE '' END), 1, 10))::BIGINT AS h
      FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0 ELSE 2.0 END AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
       - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, w * max(level) OVER ()) AS target FROM l),
p AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM t),
c AS (SELECT d.source, h, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto, sum(size) AS words
      FROM d GROUP BY d.source, h),
e AS (SELECT c.source, h, upto, words, target - whole * source_size AS budget,
             row_number() OVER (PARTITION BY c.source ORDER BY upto <= target - whole * source_size,
               CASE WHEN upto <= target - whole * source_size THEN -h ELSE h END) AS n
      FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
b AS (SELECT source, h + (words - (budget - (upto - words)) < budget - (upto - words))::BIGINT AS threshold
      FROM e WHERE n = 1)
SELECT d.doc_id, d.size::BIGINT AS size, p.source_size, p.target,
       (d.size * (p.whole + (d.h < b.threshold)::BIGINT))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
