"""Temporal analytics over a timestamp column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .stat_rules import gaps

# Lengths of the usual frequencies in seconds.
LADDER = (("secondly", 1), ("minutely", 60), ("hourly", 3600), ("daily", 86400), ("weekly", 604800), ("monthly", 2629746), ("quarterly", 7889238), ("yearly", 31556952))


def frequency(df: DataFrame, field: str) -> dict:
    """The nearest usual frequency of the median interval, and the share of intervals within a fifth of the median."""
    g = gaps(df, field)
    median = (quantiles(g, F.col("seconds"), (0.5,)) or [None])[0]
    if median is None:
        return {"frequency": None, "median": None, "regular": None}
    near = g.agg(F.avg((F.abs(F.col("seconds") - median) <= 0.2 * median).cast("double"))).first()[0]
    name = next((k for k, s in LADDER if median <= 1.5 * s), "irregular")
    return {"frequency": name, "median": median, "regular": near}


def gap_summary(df: DataFrame, field: str, factor: float = 2.0) -> DataFrame:
    """Intervals of over `factor` medians."""
    g = gaps(df, field)
    median = (quantiles(g, F.col("seconds"), (0.5,)) or [0.0])[0]
    return g.agg(F.count(F.lit(1)).alias("intervals"), F.count_if(F.col("seconds") > factor * median).alias("gaps"), F.round(F.max("seconds"), 3).alias("longest"))


def calendar(df: DataFrame, field: str) -> DataFrame:
    """unit, slot, n: rows by hour, weekday (0: Monday), month and quarter, from one pass."""
    t = F.col(field).cast("timestamp")
    slots = F.array(*(F.struct(F.lit(u).alias("unit"), v.cast("int").alias("slot")) for u, v in (("hour", F.hour(t)), ("weekday", F.weekday(t)), ("month", F.month(t)), ("quarter", F.quarter(t)))))
    return df.where(t.isNotNull()).select(F.explode(slots).alias("x")).groupBy("x.unit", "x.slot").agg(F.count(F.lit(1)).alias("n"))


def red_flags(df: DataFrame, field: str) -> DataFrame:
    t = F.col(field).cast("timestamp")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return df.where(t.isNotNull()).agg(share((F.hour(t) == 0) & (F.minute(t) == 0) & (F.second(t) == 0)).alias("midnight"), share(F.weekday(t) >= 5).alias("weekend"), share(F.hour(t).between(9, 16)).alias("business_hours"))


def trend(df: DataFrame, field: str, value) -> DataFrame:
    """Slope and fit of daily means of a value."""
    days = df.groupBy(F.to_date(field).alias("d")).agg(F.avg(value).alias("v"))
    x = F.datediff("d", F.lit("1970-01-01"))
    return days.agg(F.round(F.regr_slope("v", x), 6).alias("slope"), F.round(F.regr_r2("v", x), 6).alias("r2"))


def autocorrelation(df: DataFrame, field: str, lags: int = 7) -> DataFrame:
    """lag, r of daily row counts, for lags of 1 day and more (bounded by the days in the data)."""
    days = df.where(F.col(field).isNotNull()).groupBy(F.to_date(field).alias("d")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    later = days.select(F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"), F.col("d").alias("d0"), F.col("v").alias("v0")).withColumn("d", F.expr("date_add(d0, lag)"))
    return later.join(days, "d").groupBy("lag").agg(F.round(F.corr("v0", "v"), 6).alias("r"))
