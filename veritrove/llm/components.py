"""Connected components with DataFrame operations: alternating large-star and small-star rounds.

After each round the links are cut with a reliable checkpoint. A node with very many links is no problem: minima are
combined before each shuffle, and a link's row is joined with one row a node, so a hot node's links can be split over
tasks by the adaptive join. Rounds grow with the logarithm of the longest chain.

Up to DRIVER_LINKS links (16 bytes each) are solved on the driver instead, with the same result: there, the rounds'
dozens of shuffles cost more files, tasks and driver memory than the links themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DRIVER_LINKS = 1 << 19


def _large_star(links: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Joins a node and its smaller neighbours to the smallest of them. Links have a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def solve(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links (a, b), and for each the smallest node it can reach: the larger root of a link is hooked to the smaller."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (node, component): each linked node with the smallest node it can reach.

    Links of a node to itself and null ends are ignored; repeated links do no harm; no links give an empty table.
    """
    links = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    if links.count() <= DRIVER_LINKS:
        got = links.select(F.col("a").cast("long"), F.col("b").cast("long")).toArrow()
        node, component = solve(*(got.column(c).to_numpy() for c in ("a", "b")))
        found = pa.table({"node": pa.array(node, pa.int64()), "component": pa.array(component, pa.int64())})
        return cut(links.sparkSession.createDataFrame(found, "node long, component long"))
    state = None
    while True:
        links = cut(_small_star(_large_star(links)))
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
