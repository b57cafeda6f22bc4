"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of one label are scaled to length 1 and turned onto the principal axes
of all vectors, so that leading dimensions carry most of every product. A label
is dealt into tiles along its first axis; pairs of tiles whose ranges lie
further apart than a link allows are left out, the others compared: products
accumulate over a few leading dimensions at a time, what the rest can add is
bounded by the product of the suffix norms, and pairs that cannot reach the
threshold any more are dropped. Survivors are decided by their double cosine.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitflow.llm.common import cut
from pitflow.llm.components import connected_components, local_roots

COSINE = 0.93
#: Different vectors in a tile, about. A task holds two tiles.
TILE = 4096
#: Rows of a tile that are multiplied at once with the whole other tile.
STRIP = 256
#: Leading dimensions of the first step; each later step doubles them.
LEADING = 8
#: The first axis is cut into this many steps from -1 to 1 to deal out tiles.
STEPS = 2048
#: Slack of the bounds for rounding; only survivors of the exact test link.
SLACK = 1e-6


def unit(vector: np.ndarray | None) -> list[float] | None:
    """The vector at length 1 in double precision; None if it is null, empty,
    zero or holds null or non-finite components."""
    if vector is None or len(vector) == 0:
        return None
    x = np.array(vector, dtype=np.float64)  # null components become nan
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0:
        return None
    x = x / top
    return (x / math.sqrt(x @ x)).tolist()


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(label, embedding, rep, copies, x): usable vectors, one row for equal ones
    with their smallest vec_id and number, x at length 1."""

    @F.pandas_udf("array<double>")
    def units(rows: pd.Series) -> pd.Series:
        return pd.Series([unit(v) for v in rows], dtype=object)

    usable = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    groups = usable.groupBy("label", "embedding").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies")
    )
    return cut(groups.withColumn("x", units("embedding")).where("x IS NOT NULL"))


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors, orthonormal axes in order of falling second
    moment, over all rows. Tasks sum the products; a row per axis and partial
    sum leaves them, and a matrix per length of vectors reaches the driver."""

    def moments(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch["x"].to_numpy(zero_copy_only=False)
            for d in {len(r) for r in rows}:
                x = np.array([r for r in rows if len(r) == d])
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, m in sums.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "row": [r.tolist() for r in m]})

    rows = (
        units.select("x")
        .mapInArrow(moments, "d long, i long, row array<double>")
        .select("d", "i", F.posexplode("row").alias("j", "v"))
        .groupBy("d", "i", "j")
        .agg(F.sum("v").alias("v"))
        .toPandas()
    )
    axes = {}
    for d, part in rows.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["v"]
        values, vectors = np.linalg.eigh((m + m.T) / 2)
        axes[int(d)] = vectors[:, ::-1]
    return axes


def linked_pairs(x: np.ndarray, y: np.ndarray, turn: np.ndarray, cosine: float, same: bool):
    """Strips of (row of x, row of y) with cosine at least ``cosine``; in one and
    the same tile the first before the second."""
    d = x.shape[1]
    px, py = x @ turn, y @ turn
    steps, at = [], 0
    while at < d:
        steps.append((at, min(d, max(LEADING, 2 * at))))
        at = steps[-1][1]

    def suffix(p: np.ndarray) -> list[np.ndarray]:
        return [np.sqrt(np.square(p[:, b:]).sum(axis=1)) for _, b in steps]

    sx, sy = suffix(px), suffix(py)
    for start in range(0, len(x), STRIP):
        stop = min(len(x), start + STRIP)
        a0, b0 = steps[0]
        part = px[start:stop, a0:b0] @ py[:, a0:b0].T
        alive = part + sx[0][start:stop, None] * sy[0][None, :] >= cosine - SLACK
        if same:
            alive &= np.arange(start, stop)[:, None] < np.arange(len(y))[None, :]
        i, j = np.nonzero(alive)
        part = part[i, j]
        i += start
        for k, (a, b) in enumerate(steps[1:], 1):
            if not len(i):
                break
            part = part + np.einsum("nd,nd->n", px[i, a:b], py[j, a:b])
            on = part + sx[k][i] * sy[k][j] >= cosine - SLACK
            i, j, part = i[on], j[on], part[on]
        if len(i):
            exact = np.einsum("nd,nd->n", x[i], y[j]) >= cosine
            if exact.any():
                yield i[exact], j[exact]


def compared(units: DataFrame, axes: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(rep, links, root) from every pair of tiles that can hold links: how many
    vectors it links to rep, and the smallest rep it joins it with."""
    lead = {d: a[:, 0] for d, a in axes.items()}
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))

    @F.pandas_udf("double")
    def first_axis(rows: pd.Series) -> pd.Series:
        return pd.Series([float(r @ lead[len(r)]) for r in rows], dtype="float64")

    d = F.size("x").alias("d")
    placed = cut(units.select("label", d, "rep", "copies", "x", first_axis("x").alias("lead")))
    step = F.floor((F.col("lead") + 1) * (STEPS / 2)).cast("int").alias("step")
    rows = placed.withColumn("step", step)
    steps = rows.groupBy("label", "d", "step").agg(F.count("*").alias("many"))
    along = Window.partitionBy("label", "d").orderBy("step")
    steps = steps.select(
        "label", "d", "step", "many", (F.sum("many").over(along) - F.col("many")).alias("before")
    )
    # Within a step the hash deals rows out, so a crowded step is split as well.
    rank = F.col("before") + F.pmod(F.xxhash64("rep"), F.col("many"))
    tiled = cut(
        rows.join(steps, ["label", "d", "step"]).select(
            "label", "d", F.floor(rank / TILE).cast("int").alias("tile"), "rep", "copies", "x", "lead"
        )
    )
    tiles = tiled.groupBy("label", "d", "tile").agg(F.min("lead").alias("low"), F.max("lead").alias("high"))
    a, b = tiles.alias("a"), tiles.alias("b")
    pairs = a.join(
        b,
        (F.col("a.label") == F.col("b.label"))
        & (F.col("a.d") == F.col("b.d"))
        & (F.col("a.tile") <= F.col("b.tile"))
        & (F.col("b.low") - F.col("a.high") <= radius + SLACK)
        & (F.col("a.low") - F.col("b.high") <= radius + SLACK),
    ).select("a.label", "a.d", F.col("a.tile").alias("i"), F.col("b.tile").alias("j"))
    pairs = cut(pairs)
    right_of = pairs.where("i != j").withColumn("tile", F.col("j")).withColumn("side", F.lit(1))
    sides = pairs.withColumn("tile", F.col("i")).withColumn("side", F.lit(0)).unionByName(right_of)
    dealt = tiled.drop("lead").join(sides, ["label", "d", "tile"])

    def task(key, group):
        dim = key[1].as_py()
        side = group["side"].to_numpy()
        flat = group["x"].combine_chunks().values.to_numpy().reshape(-1, dim)
        reps, copies = group["rep"].to_numpy(), group["copies"].to_numpy()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = key[2].as_py() == key[3].as_py()
        if same:
            right = left
        links = np.zeros(len(side), dtype=np.int64)
        root = np.arange(len(side))
        for i, j in linked_pairs(flat[left], flat[right], axes[dim], cosine, same):
            i, j = left[i], right[j]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            # keep the forest so far: hang every node below the smallest it reaches
            hung = np.flatnonzero(root != np.arange(len(root)))
            root = local_roots(len(root), np.append(hung, i), np.append(root[hung], j))
        at = np.flatnonzero(links)
        return pa.table({"rep": reps[at], "links": links[at], "root": reps[root[at]]})

    return dealt.groupBy("label", "d", "i", "j").applyInArrow(task, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id,
    embedding, label).

    Links hold between vectors of equal, non-null label and equal length whose
    cosine is at least ``cosine``, a value above 0. Null, empty and zero vectors
    and such with null or non-finite components have no links, nor have rows
    without vec_id, whose component and kept are null. Equal vectors are
    compared once, with their number; so are repeated rows. Empty tables give
    no rows; other columns are not read.
    """
    vectors = vectors.select("vec_id", "label", "embedding")
    groups = distinct_vectors(vectors)
    axes = principal_axes(groups)
    found = cut(compared(groups, axes, cosine))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    graph = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    member = (
        groups.select("label", "embedding", "rep", "copies")
        .join(links, "rep", "left")
        .join(graph.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("label").alias("l"),
            F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    named = F.col("vec_id").isNotNull()
    joined = vectors.join(member, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.when(named, F.coalesce("component", "vec_id"))
    return joined.select(
        "vec_id",
        F.when(named, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
