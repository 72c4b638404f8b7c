"""Disjoint sets: inside a task with numpy, and over a whole edge table with Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.storage import materialize


def roots(parent: np.ndarray) -> np.ndarray:
    """Parents followed to the end."""
    while True:
        above = parent[parent]
        if np.array_equal(above, parent):
            return parent
        parent = above


def join_sets(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Merge the sets of ``left[i]`` and ``right[i]``; every set keeps its smallest position as root."""
    parent = roots(parent)
    while True:
        a, b = parent[left], parent[right]
        apart = a != b
        if not apart.any():
            return parent
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        parent = roots(parent)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Alternating star contraction: every node's larger, then smaller neighbours are hung on its smallest neighbour until
    nothing moves, in a number of rounds that grows with the logarithm of the longest path. Minima are combined before the
    shuffle; a hub's rows are only joined to one row of its own, which adaptive execution splits. Every round is cut by a
    written table, so a lost executor costs one round. Loops and repeated edges are ignored; null ends are dropped.
    """
    pairs = (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    mark, current = None, materialize(pairs, "edges")
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = materialize(least.select("u", F.col("m").alias("v")).union(moved).distinct(), "edges")
        seen = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("u").cast("decimal(38,0)") - F.col("v"))).first()
        if seen == mark:
            break
        mark = seen
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
