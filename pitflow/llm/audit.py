"""Filter interaction audit by a Gray-code walk over the subsets of filters.

Every document has a mask of the filters that it fails. Spark sums documents,
good and toxic ones by part and mask: at most 32 cells a part, however many
documents. A task then walks the 32 subsets of filters so that each step
toggles one filter. Every cell counts how many active filters it fails; when the
count leaves zero its documents leave the survivors, and when it returns to zero
they come back. The survivors of all subsets are kept, and every figure of every
order of filters is a difference of two of them.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.llm.common import WORD

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The filter that looks at other documents too.
COPY = "E"
REPORT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def own_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone; true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    count = F.size(words)
    return {
        "A": count < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * count,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, documents, good, toxic) of ``docs`` (doc_id, text, source), a
    row per part and mask that occurs.

    Texts are compared by their SHA-256. Copies are summed before and after each
    shuffle, and only ids, digests and masks are shuffled, so neither a text
    that a third of the rows hold nor such an id gathers in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = sum((F.when(fails, bit(name)).otherwise(0) for name, fails in own_failures(text).items()), F.lit(0))
    facts = (
        docs.select(
            "doc_id",
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(text, 256)).alias("digest"),
            own.alias("own"),
        )
        .groupBy("doc_id", "digest", "part", "own")
        .agg(F.count("*").alias("n"))
    )
    marks = labels.groupBy(F.col("doc_id").alias("marked")).agg(
        F.max(F.col("quality") == 1).alias("is_good"), F.max(F.col("toxic") == 1).alias("is_toxic")
    )
    flags = [F.coalesce(flag, F.lit(False)).alias(flag) for flag in ("is_good", "is_toxic")]
    marked = facts.join(marks, facts.doc_id == marks.marked, "left").select(*facts.columns, *flags)
    alike = marked.groupBy("digest", "part", "own", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("unnamed"),
        F.min("doc_id").alias("low"),
        F.min_by(F.struct("n"), "doc_id")["n"].alias("at_low"),
    )
    # A few rows a text by now: its copies in the same part, with the same labels, are one row.
    first = F.min("low").over(Window.partitionBy("digest"))
    passing = F.col("unnamed") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    counted = alike.withColumn("passing", passing)
    sides = F.array(
        F.struct(F.col("own").alias("mask"), F.col("passing").alias("n")),
        F.struct((F.col("own") + bit(COPY)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    return (
        counted.select("part", "is_good", "is_toxic", F.explode(sides).alias("side"))
        .groupBy("part", F.col("side.mask").alias("mask"))
        .agg(
            F.sum("side.n").alias("documents"),
            F.sum(F.when(F.col("is_good"), F.col("side.n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("is_toxic"), F.col("side.n")).otherwise(0)).alias("toxic"),
        )
    )


def walk(cells: dict[int, np.ndarray]) -> np.ndarray:
    """The survivors of each subset of filters, by subset: counts of documents,
    good and toxic ones, from the counts of the cells by mask."""
    active = dict.fromkeys(cells, 0)
    survivors = sum(cells.values(), np.zeros(3, dtype=np.int64))
    states = np.zeros((SUBSETS, 3), dtype=np.int64)
    states[0], subset = survivors, 0
    for step in range(1, SUBSETS):
        toggled = step & -step  # the bit in which a Gray code changes
        subset ^= toggled
        change = 1 if subset & toggled else -1
        for mask, counts in cells.items():
            if mask & toggled:
                active[mask] += change
                if active[mask] == max(change, 0):  # from or to no active failure
                    survivors = survivors - change * counts
        states[subset] = survivors
    return states


def step_figures(states: np.ndarray):
    """(order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley) of every order of filters, from the subsets' survivors."""
    n, everything = len(FILTERS), SUBSETS - 1
    shapley = {}
    for name in FILTERS:
        without = [s for s in range(SUBSETS) if not s & bit(name)]
        orders = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in without}
        shapley[name] = sum(orders[s] * int(states[s][0] - states[s | bit(name)][0]) for s in without)
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | bit(name)
            lost = states[before] - states[after]
            failing = states[0] - states[bit(name)]
            alone = states[everything ^ bit(name)] - states[everything]
            yield (
                "".join(order), step, states[after][0], lost[0], failing[0] - lost[0], alone[0],
                lost[1], lost[2], shapley[name],
            )
            before = after


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order of the five filters and step, zeros included.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic.
    A part is a value of source, null and the empty string together. Null texts
    are empty ones and copies of each other. Rows without doc_id are copies of
    nothing and have no label; rows that repeat an id are not copies of one
    another by that, but of any row with the same text and a smaller id. Of
    several labels of one id, any 1 counts. Texts of any length are read whole,
    empty tables give no rows, and other columns are not read.
    """

    def task(key, rows):
        columns = [rows[c].to_numpy() for c in ("documents", "good", "toxic")]
        cells = dict(zip(rows["mask"].to_pylist(), np.stack(columns, axis=1)))
        figures = list(zip(*step_figures(walk(cells))))
        names = ["part", *(f.split()[0] for f in REPORT.split(", ")[1:])]
        types = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        columns = [[key[0].as_py()] * len(figures[0]), *figures]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return mask_cells(docs, labels).groupBy("part").applyInArrow(task, REPORT)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM {docs}),
l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic
  FROM {labels} GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 200)::INT
         + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT
         + 16 * coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order,
         [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
  SELECT filter_order, step::INT AS step, bits[step] AS bit,
         coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
  FROM o, range(1, 6) AS r(step)),
r AS (
  SELECT part, filter_order, step, bit,
         coalesce(sum(n) FILTER (mask & (before + bit) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
