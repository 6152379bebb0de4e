"""Isolation forest: trees grown on the driver from bounded hash samples, broadcast, and scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, SAMPLE, POOL = 100, 256, 5000


def _tree(x: np.ndarray, depth: int, rng: np.random.Generator) -> tuple:
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else np.zeros(0, int)
    if depth == 0 or not len(spread):
        return (len(x),)
    k = int(rng.choice(spread))
    cut = rng.uniform(x[:, k].min(), x[:, k].max())
    low = x[:, k] <= cut
    return (k, cut, _tree(x[low], depth - 1, rng), _tree(x[~low], depth - 1, rng))


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _depths(tree: tuple, x: np.ndarray, depth: int = 0) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _expected(tree[0]))
    out, low = np.empty(len(x)), x[:, tree[0]] <= tree[1]
    out[low], out[~low] = _depths(tree[2], x[low], depth + 1), _depths(tree[3], x[~low], depth + 1)
    return out


def isolation_scores(df: DataFrame, columns: list[str], contamination: float = 0.05, seed: int = 7) -> DataFrame:
    """Adds score (0 to 1, higher: easier to isolate) and anomaly (over the 1 - contamination quantile)."""
    rng = np.random.default_rng(seed)
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    pool = np.array([list(r) for r in rows.orderBy(F.xxhash64(*columns, F.lit(seed))).limit(POOL).collect()]).reshape(-1, len(columns))
    size = min(SAMPLE, len(pool))
    trees = [_tree(pool[rng.choice(len(pool), size, replace=False)], int(np.ceil(np.log2(max(2, size)))), rng) for _ in range(TREES)] if size else []
    sent = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], axis=1)
            depth = np.mean([_depths(t, x) for t in sent.value], axis=0) if len(x) and sent.value else np.zeros(len(x))
            yield b.append_column("score", pa.array(2 ** (-depth / (_expected(size) or 1.0))))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    scored = df.mapInArrow(run, f"{kind}, score double")
    edge = scored.agg(F.percentile_approx("score", 1 - contamination)).first()[0]
    return scored.withColumn("anomaly", F.col("score") > F.lit(edge))
