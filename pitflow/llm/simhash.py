"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two 64-bit fingerprints differ in at most four bits exactly if some value lies
within two bits of both. So every distinct fingerprint emits the 2,081 values
of its ball of radius two, equal values meet, and meeting fingerprints are
checked and linked. The shuffle is on the leading ``bits`` of the values: all
values of one fingerprint that share them travel as one row of 16 bytes, and
the task spells out the remaining bits. Crowded buckets get further bits. A value's finders are linked in a
chain, never pair by pair, and each task hands on a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pitflow.llm.common import cut
from pitflow.llm.components import connected_components, local_roots

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Values spelled out at once in a task; larger sets are split by further bits.
SPELLED = 1 << 21
#: Links that a task holds at most, besides those of one step and a forest.
HELD_LINKS = 1 << 20
#: Values that a bucket of the shuffle should have on average.
BUCKET_VALUES = 1 << 22
#: Fingerprints from which on a bucket is parted, by how many bits, and up to how many in all.
CROWDED, STEP_BITS, MOST_BITS = 1 << 16, 8, 56
ONE = np.uint64(1)


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed long."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(n)), dtype=">u8", count=n
    )
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, 4096):
        bits = np.unpackbits(hashes[start : start + 4096].view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">i8")[0])


@F.pandas_udf(LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; null and word-less texts have fingerprint 0.
    bytes.lower() and bytes.split() know exactly A-Z and the six ASCII spaces."""
    return docs.select("doc_id", _fingerprint("text").alias("fp"))


def leading_bits(fingerprint_count: int) -> int:
    """Bits of the shuffle key, so that a bucket has about BUCKET_VALUES values."""
    return int(np.clip(np.ceil(np.log2(max(1, fingerprint_count * 2081 / BUCKET_VALUES))), 6, 30))


def _ball_sizes(spare: np.ndarray, bits: int) -> np.ndarray:
    return np.array([1, 1 + bits, 1 + bits + bits * (bits - 1) // 2])[spare]


def meetings(keys: np.ndarray, spare: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[tuple]:
    """Pairs of ids whose ``bits``-bit keys have a value in common within their
    spare distances; chains through all finders of a value."""
    if len(keys) < 2:
        return
    if bits > 0 and _ball_sizes(spare, bits).sum() > SPELLED:
        step = min(4, bits)
        head = (keys >> np.uint64(bits - step)).astype(np.uint8)
        tail = keys & np.uint64((1 << (bits - step)) - 1)
        for value in range(1 << step):
            left = spare - np.bitwise_count(head ^ np.uint8(value)).astype(np.int8)
            inside = left >= 0
            yield from meetings(tail[inside], left[inside], ids[inside], bits - step)
        return
    masks = [ONE << np.uint64(i) for i in range(bits)]
    near = np.array(masks, dtype=np.uint64)
    far = np.array([x | y for x, y in combinations(masks, 2)], dtype=np.uint64)
    values, finders = [keys], [ids]
    for least, flips in ((1, near), (2, far)):
        at = spare >= least
        if len(flips) and at.any():
            values.append((keys[at][:, None] ^ flips[None, :]).ravel())
            finders.append(np.repeat(ids[at], len(flips)))
    value, finder = np.concatenate(values), np.concatenate(finders)
    order = np.argsort(value)
    value, finder = value[order], finder[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    if len(same):
        yield finder[same], finder[same + 1]


def bucket_links(key: int, fps: np.ndarray, reps: np.ndarray, bits: int) -> tuple:
    """The links that one bucket shows, as a spanning forest over ``reps``. Links
    are folded into the forest whenever HELD_LINKS have come together."""
    rest = 64 - bits
    fp = fps.view(np.uint64)
    off = np.bitwise_count((fp >> np.uint64(rest)) ^ np.uint64(key)).astype(np.int8)
    residual = fp & np.uint64((1 << rest) - 1)
    nodes = np.arange(len(fp))
    root, held, size = nodes, [], 0

    def folded() -> np.ndarray:
        hung = np.flatnonzero(root != nodes)
        a, b = (np.concatenate(x) for x in zip(*held, (hung, root[hung])))
        return local_roots(len(fp), a, b)

    for a, b in meetings(residual, (RADIUS // 2 - off).astype(np.int8), nodes, rest):
        linked = (np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS) & (root[a] != root[b])
        held.append((a[linked], b[linked]))
        size += len(held[-1][0])
        if size > HELD_LINKS:
            root, held, size = folded(), [], 0
    root = folded()
    hung = np.flatnonzero(root != nodes)
    return reps[hung], reps[root[hung]]


def buckets(nodes: DataFrame, bits: int) -> list[tuple[int, DataFrame]]:
    """(bits, rows): fp and key, the leading bits of values in its ball. Buckets of
    more than CROWDED fingerprints are parted by further leading bits, and again,
    as each fingerprint has values in a few of the parts only."""

    def flips(width: int) -> list[tuple[int, int]]:
        sets = [c for distance in range(RADIUS // 2 + 1) for c in combinations(range(width), distance)]
        return [(sum(1 << i for i in c), len(c)) for c in sets]

    def next_bits(upto: int, width: int) -> Column:
        return F.shiftrightunsigned("fp", 64 - upto).bitwiseAND((1 << width) - 1)

    masks = F.array(*(F.lit(m) for m, _ in flips(bits)))
    keys = F.transform(masks, lambda m: next_bits(bits, bits).bitwiseXOR(m.cast("long")))
    rows, found = nodes.select("fp", F.explode(keys).alias("key")), []
    while True:
        crowded = rows.groupBy("key").count().where(F.col("count") > CROWDED).select("key")
        if bits + STEP_BITS > MOST_BITS or (crowded := cut(crowded)).isEmpty():
            return [*found, (bits, rows)]
        found.append((bits, rows.join(crowded, "key", "left_anti")))
        spare = RADIUS // 2 - F.bit_count(next_bits(bits, bits).bitwiseXOR(F.col("key")))
        options = F.array(*(F.struct(F.lit(m).cast("long").alias("m"), F.lit(d).alias("d")) for m, d in flips(STEP_BITS)))
        own = next_bits(bits + STEP_BITS, STEP_BITS)
        allowed = F.filter(options, lambda o: o["d"] <= spare)
        parts = F.transform(allowed, lambda o: F.shiftleft("key", STEP_BITS) + own.bitwiseXOR(o["m"]))
        rows = rows.join(crowded, "key", "left_semi").select("fp", F.explode(parts).alias("key"))
        bits += STEP_BITS


def near_groups(prints: DataFrame) -> DataFrame:
    """(fp, root) for every distinct fp of ``prints`` (fp), root being the smallest
    fp reachable. A node is a fingerprint, so neither repeated ids nor missing
    ones join or part groups."""
    nodes = cut(prints.select("fp").distinct())
    first = leading_bits(nodes.count())

    def links(bits: int, rows: DataFrame) -> DataFrame:
        def task(key, group):
            fps = group["fp"].to_numpy()
            a, b = bucket_links(key[0].as_py(), fps, fps, bits)
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        return rows.groupBy("key").applyInArrow(task, "a long, b long")

    each = [links(bits, rows) for bits, rows in buckets(nodes, first)]
    found = connected_components(reduce(DataFrame.unionAll, each))
    return nodes.join(found, nodes.fp == found.node, "left").select(
        "fp", F.coalesce("component", "fp").alias("root")
    )


def simhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    fingerprint: 16 lowercase hex digits. Equal texts, repeated rows included,
    have equal fingerprints and so one component, the smallest doc_id in it. Rows
    without doc_id link like others, but their own component_id is null. A row
    that repeats an id with another text is in its own text's group. Empty tables
    give no rows; other columns are not read.
    """
    prints = cut(fingerprints(docs))
    groups = near_groups(prints).withColumnRenamed("fp", "group_fp")
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = cut(lowest.join(groups, F.col("fp") == F.col("group_fp")).select("group_fp", "root", "low"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("low").alias("component"))
    member = named.join(least, F.col("root") == F.col("r")).select("group_fp", "component")
    return prints.join(member, F.col("fp") == F.col("group_fp"), "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"),
    )


def dedupe(docs: DataFrame) -> DataFrame:
    """One row of each group, all its columns: that with the smallest doc_id, rows
    without one last, then with the smallest hash of its text; of rows that share
    id and text, that with the smallest hash of all columns.

    Every group keeps a row, so no text goes without a near copy that stays, even
    where an id repeats with other texts. Null and empty texts and such of white
    space are one group. Empty tables give no rows. The texts are shuffled once.
    """
    prints = cut(docs.select("doc_id", F.xxhash64("text").alias("h"), _fingerprint("text").alias("fp")))
    alike = prints.groupBy("doc_id", "h", "fp").agg(F.count("*").alias("n"))
    groups = near_groups(prints).withColumnRenamed("fp", "group_fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h", "n")).alias("k")
    # One row a fingerprint before the join, so the copies of a hot one do not meet there.
    of_print = alike.groupBy("fp").agg(first).join(groups, F.col("fp") == F.col("group_fp"))
    kept = cut(of_print.groupBy("root").agg(F.min("k").alias("k")).select("k"))
    rows = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("doc.text") == F.col("k.h"))
    taken = rows.join(kept, same)
    repeated = F.col("k.n") > 1
    if kept.where(repeated).isEmpty():
        return taken.select("doc.*")
    # Rows that repeat id and text meet in one aggregate, combined before its shuffle.
    one_each = taken.where(repeated).groupBy("k").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc"))
    return taken.where(~repeated).select("doc.*").unionAll(one_each.select("doc.*"))
