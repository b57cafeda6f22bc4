"""Sharding by best-fit-decreasing bin packing.

Groups of equal texts are indivisible. Groups sorted by size enter the bin with
the tightest remaining capacity that still takes them, found in a balanced
tree; the capacity is the smallest that fills no more than the wanted shards.

Groups of one size are interchangeable, so the driver packs runs: sizes with the
number of groups that have them. A corpus of B bytes has at most sqrt(2 B)
different sizes, however many groups. A run fills the tightest bin until no more
of it fits, exactly as its groups would one by one. Each group then finds its bin
by its number among the groups of its size. Only a group larger than a whole
shard is divided, by the numbers of its rows, as no packing could make shards
near equal otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitflow.llm.common import cut

SHARDS = 16
#: Share of a shard from which on a group's rows are told its bin by broadcast, not by a shuffle.
LARGE = 1 / 512
#: Parts per shard that a group larger than a shard is divided into.
PARTS = 64
#: Rows of a shard, a group or a size that one task numbers, about.
CELL_ROWS = 1 << 17


class _Node:
    __slots__ = ("key", "bins", "left", "right", "height")

    def __init__(self, key: int, bin_: int):
        self.key, self.bins, self.left, self.right, self.height = key, [bin_], None, None, 1


class Capacities:
    """Bins by remaining capacity, in an AVL tree."""

    def __init__(self):
        self.root: _Node | None = None

    def add(self, key: int, bin_: int) -> None:
        self.root = self._add(self.root, key, bin_)

    def take_tightest(self, least: int) -> tuple[int, int] | None:
        """Remove the bin with the smallest remaining capacity of ``least`` or
        more; of equal ones that with the lowest number. (capacity, bin)"""
        node, best = self.root, None
        while node:
            if node.key >= least:
                best, node = node, node.left
            else:
                node = node.right
        if best is None:
            return None
        key, bin_ = best.key, min(best.bins)
        if len(best.bins) > 1:
            best.bins.remove(bin_)
        else:
            self.root = self._drop(self.root, key)
        return key, bin_

    def _add(self, node, key, bin_):
        if node is None:
            return _Node(key, bin_)
        if key == node.key:
            node.bins.append(bin_)
        elif key < node.key:
            node.left = self._add(node.left, key, bin_)
        else:
            node.right = self._add(node.right, key, bin_)
        return self._balanced(node)

    def _drop(self, node, key):
        if key < node.key:
            node.left = self._drop(node.left, key)
        elif key > node.key:
            node.right = self._drop(node.right, key)
        elif node.left is None or node.right is None:
            return node.left or node.right
        else:
            low = node.right
            while low.left:
                low = low.left
            node.key, node.bins = low.key, low.bins
            node.right = self._drop(node.right, low.key)
        return self._balanced(node)

    @staticmethod
    def _height(node) -> int:
        return node.height if node else 0

    def _turn(self, node, side: str):
        other = "left" if side == "right" else "right"
        up = getattr(node, other)
        setattr(node, other, getattr(up, side))
        setattr(up, side, node)
        for n in (node, up):
            n.height = 1 + max(self._height(n.left), self._height(n.right))
        return up

    def _balanced(self, node):
        node.height = 1 + max(self._height(node.left), self._height(node.right))
        lean = self._height(node.left) - self._height(node.right)
        if lean > 1:
            if self._height(node.left.left) < self._height(node.left.right):
                node.left = self._turn(node.left, "left")
            return self._turn(node, "right")
        if lean < -1:
            if self._height(node.right.right) < self._height(node.right.left):
                node.right = self._turn(node.right, "right")
            return self._turn(node, "left")
        return node


Run = tuple[int, int]


def pack_runs(runs: Sequence[Run], capacity: int) -> tuple[list[list[Run]], int]:
    """For each run (size, how many), sizes falling: (bin, how many) in the order in
    which best fit decreasing fills them; and the bins used."""
    filled, used, free = [], 0, Capacities()
    for size, many in runs:
        parts = []
        while many:
            found = free.take_tightest(size)
            if found is None:
                found, used = (capacity, used), used + 1
            room, bin_ = found
            # The bin stays the tightest one until no more of this size fits.
            fits = min(many, max(1, room // size))
            free.add(room - fits * size, bin_)
            parts.append((bin_, fits))
            many -= fits
        filled.append(parts)
    return filled, used


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], int]:
    """(bin of each item, bins used); items of equal size in their given order."""
    sizes = list(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    runs = [(size, len(list(same))) for size, same in groupby(order, key=lambda i: sizes[i])]
    filled, used = pack_runs(runs, capacity)
    in_turn = [bin_ for parts in filled for bin_, many in parts for _ in range(many)]
    bins = [0] * len(sizes)
    for i, bin_ in zip(order, in_turn):
        bins[i] = bin_
    return bins, used


def near_equal(runs: Sequence[Run], shards: int) -> list[list[Run]]:
    """Best fit decreasing at the smallest capacity found that needs no more than
    ``shards`` bins: doubling steps up from an even share, then halving ones."""
    if not runs:
        return []
    largest = runs[0][0]
    low = max(-(-sum(size * many for size, many in runs) // shards), largest)
    high, step = low, 1
    while (packed := pack_runs(runs, high))[1] > shards:
        low, high, step = high + 1, high + step, step * 2
    while low < high:
        middle = (low + high) // 2
        tried = pack_runs(runs, middle)
        if tried[1] <= shards:
            high, packed = middle, tried
        else:
            low = middle + 1
    return packed[0]


def numbered(rows: DataFrame, key: Sequence[str], name: str, *order: str) -> DataFrame:
    """Adds ``name``, numbers from 0 without gaps among rows of equal ``key``. Each
    cell of a key is numbered by itself and its first number added, so no task has
    more than a cell. ``rows`` has a ``cell`` and gives the same rows on each reading."""
    along = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("count").over(along), F.lit(0)).alias("first")
    counts = rows.groupBy(*key, "cell").count()
    offsets = counts.select(*(F.col(c).alias(f"of_{c}") for c in (*key, "cell")), first)
    same = [F.col(c) == F.col(f"of_{c}") for c in (*key, "cell")]
    inside = F.row_number().over(Window.partitionBy(*key, "cell").orderBy(*order)) - 1
    found = rows.withColumn("inside", inside).join(offsets, same)
    return found.select(*rows.columns, (F.col("inside") + F.col("first")).alias(name))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of
    ``docs`` (doc_id, text).

    The law is ``bytes``. Null texts count as empty ones and are equal to them.
    Slots number a shard's rows from 0, in the order of a hash of doc_id and text
    (copies of a text with very many rows in any order); repeated rows and rows
    without id are placed one by one and get slots of their own. Texts of any
    length count with all their bytes. Empty tables give no rows; other columns
    are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),
        )
    )
    groups = cut(rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")))
    total, many, most = groups.agg(F.sum("bytes"), F.count("*"), F.max("rows")).first()
    if not many:
        total, most = 0, 0
    share = max(1, total // shards)
    spark = docs.sparkSession

    def cells(of: int) -> Column:
        return F.lit(max(1, -(-of // CELL_ROWS)))

    # Fewer groups than shards can be larger than a shard.
    divided = groups.where(F.col("bytes") > share)
    pieces = []
    for g in divided.orderBy("group").collect():
        parts = min(g["rows"], -(-g["bytes"] * PARTS // share))
        edges = [g["rows"] * i // parts for i in range(parts + 1)]
        each = g["bytes"] // g["rows"]
        pieces += [(each * (b - a), g["group"], a, b) for a, b in zip(edges, edges[1:])]
    whole = groups.where(F.col("bytes") <= share)
    sizes = whole.groupBy("bytes").agg(F.count("*").alias("many")).toPandas()
    runs = [(int(b), int(n), None) for b, n in zip(sizes["bytes"], sizes["many"])]
    runs = sorted([*runs, *((p[0], 1, p[1:]) for p in pieces)], key=lambda r: (-r[0], r[2] or ()))
    packed = near_equal([r[:2] for r in runs], shards)
    of_size, of_piece = [], []
    for (size, _, piece), parts in zip(runs, packed):
        if piece:
            of_piece.append((*piece, parts[0][0]))
            continue
        at = 0
        for bin_, n in parts:
            of_size.append((size, at, at + n, bin_))
            at += n

    def table(found: list[tuple], names: str) -> DataFrame:
        frame = pd.DataFrame(found, columns=names.split(), dtype="int64")
        return spark.createDataFrame(frame, ", ".join(f"{n} long" for n in names.split()))

    within = (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high"))
    in_sizes = numbered(whole.withColumn("cell", F.pmod("group", cells(many))), ["bytes"], "number", "group")
    bins = cut(
        in_sizes.join(table(of_size, "run low high shard"), (F.col("bytes") == F.col("run")) & within).select(
            F.col("group").alias("g"), "bytes", "rows", "shard"
        )
    )
    output = ["doc_id", "size", "text_crc32", "group", "row", "rows", "shard"]
    # No more than shards / LARGE groups are large, so the copies of a hot one need not meet.
    large, small = F.col("bytes") >= share * LARGE, F.col("bytes") < share * LARGE
    mine = F.col("group") == F.col("g")
    by_group = rows.join(F.broadcast(bins.where(large)), mine).select(*output)
    by_group = by_group.unionAll(rows.join(bins.where(small), mine).select(*output))
    if pieces:
        names = F.broadcast(divided.select(F.col("group").alias("g"), "rows"))
        parted = rows.join(names, mine).withColumn("cell", F.pmod("row", cells(most)))
        in_groups = numbered(parted, ["group"], "number", "row")
        of = F.broadcast(table(of_piece, "piece_of low high shard"))
        by_piece = in_groups.join(of, (F.col("group") == F.col("piece_of")) & within)
        by_group = by_group.unionAll(by_piece.select(*output))
    placed = cut(by_group.withColumn("order", F.xxhash64("doc_id", "group")))
    # Rows that repeat have one hash; where they are very many, the row's own number parts them.
    spread = F.when(F.col("rows") > CELL_ROWS, F.col("row")).otherwise(F.col("order"))
    n = placed.count()
    celled = placed.withColumn("cell", F.pmod(spread, cells(n // shards)))
    return numbered(celled, ["shard"], "slot", "order", "doc_id", "text_crc32").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
