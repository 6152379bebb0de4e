"""Findings over whole columns: agreement of outlier methods, odd lengths, gaps between classes, keys, references within a table."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number, string
from .quantiles import exact_quantiles, quantiles


def outlier_methods(df: DataFrame, column: str) -> DataFrame:
    """zscore, iqr, modified, any, all: how many values lie outside by |z| > 3, quartile fences at 1.5 and modified |z| > 3.5."""
    x = number(column)
    mean, sd = df.agg(F.avg(x), F.stddev_samp(x)).first()
    q = quantiles(df, x, (0.25, 0.5, 0.75))
    never = F.lit(False)
    z = iqr = modified = never
    if q is not None:
        mad = quantiles(df, F.abs(x - q[1]), (0.5,))[0]
        z = F.abs(x - mean) > 3 * sd if sd else never
        iqr = (x < q[0] - 1.5 * (q[2] - q[0])) | (x > q[2] + 1.5 * (q[2] - q[0]))
        modified = F.abs(0.6745 * (x - q[1]) / mad) > 3.5 if mad else never
    n = lambda c: F.count_if(c)
    return df.agg(n(z).alias("zscore"), n(iqr).alias("iqr"), n(modified).alias("modified"), n(z | iqr | modified).alias("any"), n(z & iqr & modified).alias("all"))


def agreement(counts: dict[str, int], total: int) -> str:
    """high, moderate or low, by how far the methods' shares of outliers lie apart."""
    shares = [counts[k] / total for k in ("zscore", "iqr", "modified")] if total else [0.0]
    spread = max(shares) - min(shares)
    return "high" if spread < 0.01 else "moderate" if spread < 0.05 else "low"


def length_anomalies(df: DataFrame, column: str, deviations: float = 3.0) -> DataFrame:
    """value, size: distinct texts whose length is further than so many deviations from the mean length."""
    size = F.length(string(column))
    mean, sd = df.agg(F.avg(size), F.stddev_pop(size)).first()
    odd = F.abs(size - mean) > deviations * sd if sd else F.lit(False)
    return df.where(odd).select(string(column).alias("value"), size.alias("size")).distinct()


def proportion_gap(df: DataFrame, category: str, target: str, first: str, second: str) -> DataFrame:
    """category, first, second, gap: each category's share of two classes, and how far these lie apart."""
    c, t = F.col(category).cast("string"), F.col(target).cast("string")
    g = df.where(c.isNotNull() & t.isin(first, second)).groupBy(c.alias("category")).agg(F.count_if(t == first).alias("a"), F.count_if(t == second).alias("b"))
    total = g.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    out = g.join(F.broadcast(total)).select("category", share("a", "na").alias("first"), share("b", "nb").alias("second"))
    return out.select("category", F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), F.round(F.abs(F.col("first") - F.col("second")), 6).alias("gap"))


def key_candidates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, distinct, nulls, is_key: whether a column's values are all there and all different."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), string(c).alias("value")) for c in columns))
    counts = df.select(F.explode(pairs).alias("x")).select("x.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("column").agg(F.sum("n").alias("n"), F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
    return out.withColumn("is_key", (F.col("distinct") == F.col("n")) & (F.col("n") > 0))


def self_reference(df: DataFrame, parent: str, key: str) -> DataFrame:
    """rows, orphans, distinct_orphans: rows with a parent, and those whose parent is no key of the table."""
    rows = df.select(F.col(parent).alias("p")).where("p IS NOT NULL").groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    keys = df.select(F.col(key).alias("p")).distinct().withColumn("found", F.lit(True))
    lost = F.when(F.col("found").isNull(), F.col("n")).otherwise(0)
    return rows.join(keys, "p", "left").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(lost), F.lit(0)).alias("orphans"), F.count_if(F.col("found").isNull()).alias("distinct_orphans"))


def category_sample(df: DataFrame, category: str, key: str, most: int) -> DataFrame:
    """At most so many rows of each category, those whose keys have the smallest MD5: a sample that does not change with the plan.

    Spark ranks within each task before the shuffle, so a large category is not gathered in one.
    """
    order = Window.partitionBy(category).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key)
    return df.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= most).drop("__rank")


def shape_class(skewness: float | None, kurtosis: float | None) -> str:
    """A name for a distribution's form, by its skewness and excess kurtosis."""
    if skewness is None or kurtosis is None:
        return "unknown"
    if abs(skewness) > 1:
        return "right_skewed" if skewness > 0 else "left_skewed"
    if abs(skewness) < 0.5:
        return "normal" if abs(kurtosis) < 1 else "uniform" if kurtosis < -1 else "heavy_tailed" if kurtosis > 1 else "symmetric"
    return "moderately_skewed"


def column_summary(df: DataFrame, columns: list[str]) -> dict[str, dict[str, Any]]:
    """column -> total, nulls, distinct, low, high (of numbers) and values (if there are 20 at most), for suggestions."""
    from .profile import is_number

    out = {r["column"]: {"total": r["n"], "nulls": r["nulls"], "distinct": r["distinct"], "low": None, "high": None, "values": None} for r in key_candidates(df, columns).collect()}
    few = [c for c in columns if c in out and 0 < out[c]["distinct"] <= 20]
    if few:
        from .profile import value_counts

        for r in value_counts(df, few).collect():
            out[r["column"]]["values"] = [*(out[r["column"]]["values"] or []), r["value"]]
    numbers = [c for c in columns if is_number(df, c)]
    if numbers:
        row = df.agg(*(f(number(c)).alias(f"{k}{i}") for i, c in enumerate(numbers) for k, f in (("low", F.min), ("high", F.max)))).first()
        for i, c in enumerate(numbers):
            if c in out:
                out[c] |= {"low": row[f"low{i}"], "high": row[f"high{i}"]}
    return out


def class_quantiles(df: DataFrame, category: str, x: Column, levels: tuple[float, ...]) -> DataFrame:
    """category, n, distinct, q of a value within each category."""
    return exact_quantiles(df.select(F.col(category).alias("key"), x.alias("x")), levels).withColumnRenamed("key", "category")
