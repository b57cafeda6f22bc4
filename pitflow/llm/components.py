"""Connected components: over a whole graph with Spark, inside a task with numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitflow.llm.common import cut


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node that each reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two long columns, a and b. Returns (node, component) for
    every node that has a link to another one, component being the smallest
    node reachable.

    Alternating stars: every node hangs its larger neighbours, then its smaller
    ones, below the smallest. Rows stay near the number of links and rounds
    near the logarithm of the longest chain. The join has the links, split by
    AQE where a hub is hot, on one side and one row per node on the other; each
    round ends in a checkpoint. Only a count and a checksum reach the driver.
    Nulls and links of a node to itself are left out.
    """
    stars = cut(
        links.where("a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = None
    while True:
        state = stars.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = (
            both.join(lowest, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .distinct()
        )
        large = cut(large)
        lowest = large.groupBy("u").agg(F.min("v").alias("low"))
        stars = cut(
            large.join(lowest, "u")
            .where("v != low")
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionAll(lowest.select("u", F.col("low").alias("v")))
            .distinct()
        )
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
