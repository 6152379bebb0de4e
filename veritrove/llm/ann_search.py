"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are dealt to blocks of about BLOCK rows; each block has TABLES hash tables of FUNCTIONS p-stable (Gaussian) hashes
of width `width`. A query visits, in every table of every block, its own bucket and PROBES - 1 perturbed ones in the order
of estimated success: perturbation vectors over {-1, 0, 1} by the sum of squared distances to the bucket borders crossed.
The candidates of all tables are merged and ranked by exact distance; a block that offers a query fewer than it asks for is
searched whole. The best of each block are merged by rank. The stated query set meets the rows block by block, so no task
holds more than a block of rows and a block of queries, however alike the vectors are, and no pair becomes a row.

The width follows the mean distance within a bounded sample (SAMPLE rows); all rows are indexed.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id, take no part; vectors meet
those of their own length only; rows with the query's id are its own; repeated queries count once; ties go to the smaller id; an
empty table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, QUERY_BLOCK = 4096, 1024
TABLES, FUNCTIONS, PROBES = 32, 6, 150
WIDTH_SHARE = 0.7
SAMPLE = 2000
SEED = 20240611


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector array<double> and dim of the rows that take part."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0.0)
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("vector"))


def sample_width(rows: DataFrame) -> float:
    """WIDTH_SHARE of the mean distance between vectors of a sample (those of the most frequent length)."""
    got = [r["vector"] for r in rows.orderBy(F.xxhash64("vec_id", "vector")).limit(SAMPLE).select("vector").collect()]
    sizes = [len(v) for v in got]
    x = np.array([v for v in got if len(v) == max(set(sizes), key=sizes.count)]) if got else np.zeros((0, 1))
    if len(x) < 2:
        return 1.0
    gaps = np.linalg.norm(x - np.roll(x, 1, axis=0), axis=1)
    return float(WIDTH_SHARE * gaps.mean()) or 1.0


class Tables:
    """p-stable hash tables over the rows of one block."""

    def __init__(self, x: np.ndarray, width: float, tables: int = TABLES, functions: int = FUNCTIONS, probes: int = PROBES):
        rng = np.random.default_rng(SEED + x.shape[1])
        self.n, self.probes = len(x), probes
        self.moves = np.array(list(product((-1, 0, 1), repeat=functions)))
        self.tables = []
        for _ in range(tables):
            a, b = rng.standard_normal((x.shape[1], functions)) / width, rng.random(functions)
            cell = np.floor(x @ a + b).astype(np.int64)
            key = self._key(cell)
            order = np.argsort(key, kind="stable")
            self.tables.append((a, b, key[order], order))

    @staticmethod
    def _key(cells: np.ndarray) -> np.ndarray:
        key = np.zeros(cells.shape[:-1], dtype=np.uint64)
        for k in range(cells.shape[-1]):
            key = (key ^ cells[..., k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return key

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """Rows of the block in the buckets that each query visits."""
        seen = np.zeros((len(queries), self.n), dtype=bool)
        for a, b, keys, order in self.tables:
            at = queries @ a + b
            cell = np.floor(at)
            inside = at - cell
            cost = inside**2 @ (self.moves == -1).T.astype(float) + (1 - inside) ** 2 @ (self.moves == 1).T.astype(float)
            best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
            wanted = self._key(cell.astype(np.int64)[:, None, :] + self.moves[best])
            first, last = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
            n = (last - first).ravel()
            hit = np.repeat(first.ravel(), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            seen[np.repeat(np.repeat(np.arange(len(queries)), best.shape[1]), n), order[hit]] = True
        return [np.flatnonzero(s) for s in seen]


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nearest(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, width: float, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, ids, distances) of the k nearest of a block that each query finds."""
    out, index = [], Tables(x, width)
    for step in range(0, len(q), 256):
        for i, found in enumerate(index.candidates(q[step : step + 256]), start=step):
            found = found[ids[found] != query_ids[i]]
            if len(found) < k:
                found = np.flatnonzero(ids != query_ids[i])
            gap = np.sqrt(((x[found] - q[i]) ** 2).sum(1))
            top = np.lexsort((ids[found], gap))[:k]
            out.append((i, ids[found][top], gap[top]))
    return out


def search(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row whose id is divisible by `every`."""
    rows = cut(usable(rows, id_col, vector_col))
    n = rows.count()
    width, blocks = sample_width(rows), max(1, -(-n // BLOCK))
    queries = rows.where(F.col("vec_id") % every == 0).distinct().withColumn("query_key", F.xxhash64("vec_id", "vector"))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    data = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = queries.withColumn("query_block", F.pmod("query_key", F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    keys = ("dim", "block", "query_block")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names)
        dim = key[0].as_py()
        query_ids, query_keys = right["vec_id"].to_numpy(), right["query_key"].to_numpy()
        found = nearest(left["vec_id"].to_numpy(), _matrix(left["vector"], dim), query_ids, _matrix(right["vector"], dim), width, k)
        at = np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found]).astype(int)
        return pa.table([query_ids[at], query_keys[at], np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found])], names)

    best = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id long, query_key long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_key").orderBy("score", "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
