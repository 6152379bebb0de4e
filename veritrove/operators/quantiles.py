"""Exact quantiles of any number of groups, without a task that sees all values of a group.

Approximate quantiles, a mergeable sketch, give two edges for each level, NEAR of the rows below and above it. The slots between the
edges are counted exactly, which tells the slots that hold the ranks asked for; only the values of these are counted one by one and
ranked. A poor edge makes a slot larger, never a result wrong. All steps are scans with map-side combination: their cost for a row
does not depend on the number of rows.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Groups of up to SLOT rows are one slot. Edges of up to FEW_GROUPS groups are sent to each task.
SLOT, NEAR, FEW_GROUPS = 10_000, 0.0005, 10_000


def _edges(values: DataFrame, levels: tuple[float, ...]) -> tuple[DataFrame, bool]:
    """of, total, edges (ascending, null: none) of each group, and whether the groups are few: then they are collected and broadcast."""
    at = sorted({min(1.0, max(0.0, p + d)) for p in map(float, levels) for d in (-NEAR, NEAR)} - {1.0})
    sketch = F.percentile_approx("x", at, 10_000) if at else F.array().cast("array<double>")
    total = F.count(F.lit(1))
    edges = values.groupBy(F.col("key").alias("of")).agg(total.alias("total"), F.when(total > SLOT, F.sort_array(sketch)).alias("edges"))
    rows = edges.limit(FEW_GROUPS + 1).collect()
    few = len(rows) <= FEW_GROUPS
    return (F.broadcast(values.sparkSession.createDataFrame(rows, edges.schema)) if few else edges), few


def ranked(values: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """key, x, n, before, total: of the distinct values around the levels, how often each occurs and how many of its group are smaller. Null x are left out."""
    values = values.select("key", F.col("x").cast("double").alias("x")).where("x IS NOT NULL")
    edges, few = _edges(values, levels)
    count = 2 * len(levels)
    slot = reduce(add, (F.coalesce((F.get("edges", F.lit(i)) < F.col("x")).cast("int"), F.lit(0)) for i in range(count)), F.lit(0))
    dealt = values.join(edges, F.col("key").eqNullSafe(F.col("of"))).select("key", "x", "total", slot.alias("slot"))
    sums = dealt.groupBy("key", "total", "slot").agg(F.count(F.lit(1)).alias("t"))
    so_far = Window.partitionBy("key").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(F.col("key").alias("of"), F.col("slot").alias("at"), "total", "t", (F.sum("t").over(so_far) - F.col("t")).alias("base"))
    ranks = [f(F.lit(float(p)) * (F.col("total") - 1)) for p in levels for f in (F.floor, F.ceil)]
    sums = sums.where(reduce(or_, ((F.col("base") <= r) & (r < F.col("base") + F.col("t")) for r in ranks))).drop("total", "t")
    # slots without a rank are left out by the join, before anything is shuffled if there are few groups
    sums = F.broadcast(sums) if few else sums
    counts = dealt.join(sums, F.col("key").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("at"))).groupBy("key", "slot", "base", "total", "x").agg(F.count(F.lit(1)).alias("n"))
    inside = Window.partitionBy("key", "slot").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("key", "x", "n", (F.col("base") + F.sum("n").over(inside) - F.col("n")).alias("before"), "total")


def exact_quantiles(values: DataFrame, levels: tuple[float, ...], distinct: bool = True) -> DataFrame:
    """key, n, distinct (if asked for), q (the quantiles of the levels, linearly interpolated) of (key, x); groups without values have no row."""

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("before") <= rank, F.col("x")))

    ends = []
    for k, p in enumerate(levels):
        rank = F.lit(float(p)) * (F.col("total") - 1)
        ends += [at(F.floor(rank)).alias(f"low{k}"), at(F.ceil(rank)).alias(f"high{k}")]
    found = ranked(values, levels).groupBy("key").agg(F.max("total").alias("n"), *ends)

    def between(k: int, p: float) -> Column:
        rank = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"low{k}"), F.col(f"high{k}")
        return F.when(low == high, low).otherwise(low + (rank - F.floor(rank)) * (high - low))

    found = found.select("key", "n", F.array(*(between(k, p) for k, p in enumerate(levels))).alias("q"))
    if not distinct:
        return found
    unlike = values.select(F.col("key").alias("of"), F.col("x").cast("double").alias("x")).where("x IS NOT NULL").distinct().groupBy("of").agg(F.count(F.lit(1)).alias("distinct"))
    return found.join(unlike, F.col("key").eqNullSafe(F.col("of"))).select("key", "n", "distinct", "q")


def quantiles(df: DataFrame, x: Column, levels: tuple[float, ...]) -> list[float] | None:
    """The quantiles of one column; None without values."""
    row = exact_quantiles(df.select(F.lit(0).alias("key"), x.alias("x")), levels, distinct=False).first()
    return row["q"] if row else None
