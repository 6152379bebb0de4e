"""Associations between columns, from grouped counts and pairwise aggregates; only small tables of results reach the driver."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import number
from .quantiles import exact_quantiles, quantiles


def _pairs(df: DataFrame, values: dict[tuple[str, str], dict]) -> DataFrame:
    keys = list(next(iter(values.values())))
    wide = df.agg(*(v.alias(f"p{i}_{k}") for i, p in enumerate(values.values()) for k, v in p.items()))
    rows = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), *(F.col(f"p{i}_{k}").alias(k) for k in keys)) for i, (a, b) in enumerate(values)]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of all pairs, in one scan."""
    return _pairs(df, {(a, b): {"r": F.round(F.corr(number(a), number(b)), 4)} for a, b in combinations(columns, 2)})


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 and the residual deviation of y on x."""
    a, b = number(y), number(x)
    r2 = F.regr_r2(a, b)
    return df.agg(F.round(F.regr_slope(a, b), 4).alias("slope"), F.round(F.regr_intercept(a, b), 2).alias("intercept"), F.round(r2, 4).alias("r2"), F.round(F.stddev_pop(F.when(b.isNotNull(), a)) * F.sqrt(1 - r2), 2).alias("residual_sd"))


def _contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 and V without a continuity correction. chi2 = n (sum of n_ab^2 / (n_a n_b) - 1), so empty cells need no rows."""
    t = _contingency(df, a, b)
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    joined = t.join(ra, "a").join(rb, "b").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n") / (F.col("na").cast("double") * F.col("nb"))).alias("s"), F.count_distinct("a").alias("ca"), F.count_distinct("b").alias("cb"))
    chi2 = F.col("n") * (F.col("s") - 1)
    return joined.select(F.round(chi2, 4).alias("chi2"), F.round(F.sqrt(F.greatest(F.lit(0.0), chi2) / (F.col("n") * F.nullif(F.least("ca", "cb") - 1, F.lit(0)))), 6).alias("v"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    t = _contingency(df, a, b)
    total = t.agg(F.sum("n").alias("total"))
    ra, rb = t.groupBy("a").agg(F.sum("n").alias("na")), t.groupBy("b").agg(F.sum("n").alias("nb"))
    x = t.join(ra, "a").join(rb, "b").join(F.broadcast(total))
    p = F.col("n") / F.col("total")
    return x.agg(F.round(F.sum(p * F.ln(p * F.col("total") * F.col("total") / (F.col("na").cast("double") * F.col("nb")))), 6).alias("mi"))


def correlation_ratio(df: DataFrame, category: str, value: str) -> DataFrame:
    """eta squared: the share of variance between groups."""
    g = df.select(F.col(category).alias("g"), number(value).alias("x")).dropna().groupBy("g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    t = g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    between = F.col("square") - F.col("n") * F.col("mean") * F.col("mean")
    return t.select(F.round(between / (between + F.col("within")), 6).alias("eta2"))


def class_statistics(df: DataFrame, category: str, value: str) -> DataFrame:
    x = number(value)
    moments = df.groupBy(F.col(category).alias("category")).agg(F.count(x).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"))
    found = exact_quantiles(df.select(F.col(category).alias("key"), x.alias("x")), (0.25, 0.5, 0.75), distinct=False).select("key", *(F.round(F.get("q", F.lit(i)), 4).alias(k) for i, k in enumerate(("q1", "median", "q3"))))
    return moments.join(found, F.col("category").eqNullSafe(F.col("key")), "left").drop("key")


def cohens_d(df: DataFrame, category: str, value: str, first: str, second: str) -> DataFrame:
    x, c = number(value), F.col(category).cast("string")
    a, b = F.when(c == first, x), F.when(c == second, x)
    pooled = F.sqrt(((F.count(a) - 1) * F.var_samp(a) + (F.count(b) - 1) * F.var_samp(b)) / (F.count(a) + F.count(b) - 2))
    return df.agg(F.round((F.avg(a) - F.avg(b)) / pooled, 6).alias("d"))


def point_biserial(df: DataFrame, flag, value: str) -> DataFrame:
    return df.agg(F.round(F.corr(flag.cast("double"), number(value)), 6).alias("r"))


def functional_dependency(df: DataFrame, source: str, target: str, least_rows: int = 5) -> DataFrame:
    """Of the source values with enough rows, how many have a single target."""
    g = df.select(F.col(source).alias("s"), F.col(target).alias("t")).dropna().groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("k")).where(F.col("n") >= least_rows)
    return g.agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("k") == 1).alias("determined"))


def co_missing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Jaccard likeness of where pairs of columns are null."""
    n = {c: F.col(c).isNull() for c in columns}
    return _pairs(df, {(a, b): {"jaccard": F.round(F.coalesce(F.try_divide(F.count_if(n[a] & n[b]), F.count_if(n[a] | n[b])), F.lit(0.0)), 6)} for a, b in combinations(columns, 2)})


def missing_by_class(df: DataFrame, column: str, target: str) -> DataFrame:
    return df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(column).isNull().cast("double")), 6).alias("missing_rate"))


def near_duplicates(df: DataFrame, column: str) -> DataFrame:
    """Values that differ in case and white space only: normal form, rows, spellings."""
    form = F.regexp_replace(F.trim(F.lower(F.col(column))), r"\s+", " ")
    return df.where(F.col(column).isNotNull()).groupBy(form.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(column).alias("spellings")).where("spellings > 1")


def rare_categories(df: DataFrame, column: str, share: float) -> DataFrame:
    g = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.join(F.broadcast(total)).where(F.col("n") < share * F.col("total")).select("value", "n")


def benford(df: DataFrame, column: str) -> DataFrame:
    """digit, n, expected: leading digits of the non-zero values."""
    d = F.regexp_extract(F.abs(number(column)).cast("string"), "([1-9])", 1)
    g = df.select(d.alias("d")).where("d <> ''").groupBy(F.col("d").cast("int").alias("digit")).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("digit", "n", F.round(F.col("total") * F.log10(1 + 1 / F.col("digit")), 4).alias("expected"))


def ratio_outliers(df: DataFrame, a: str, b: str) -> DataFrame:
    r = F.try_divide(number(a), number(b))
    x = df.select(r.alias("r")).dropna()
    q1, q3 = quantiles(x, F.col("r"), (0.25, 0.75)) or (0.0, 0.0)
    high, low = q3 + 3 * (q3 - q1), max(q1 - 3 * (q3 - q1), 0.001)
    return x.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("r") > high) | (F.col("r") < low)).alias("outliers"))


def correlation_breaks(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows whose residual is beyond the 99th percentile of residuals."""
    s, i = df.agg(F.regr_slope(number(y), number(x)), F.regr_intercept(number(y), number(x))).first()
    r = df.select(F.abs(number(y) - (F.lit(s) * number(x) + F.lit(i))).alias("r")).dropna()
    edge = (quantiles(r, F.col("r"), (0.99,)) or [None])[0]
    return r.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > F.lit(edge)).alias("breaks"))


def drift(base: DataFrame, now: DataFrame, column: str) -> DataFrame:
    """How far mean and deviation have moved, in units of the base."""
    m = lambda df, p: df.agg(F.avg(number(column)).alias(f"{p}m"), F.stddev_pop(number(column)).alias(f"{p}s"))
    both = m(base, "a").join(F.broadcast(m(now, "b")))
    return both.select(F.round(F.abs(F.col("bm") - F.col("am")) / F.col("as") + F.abs(F.ln(F.col("bs") / F.col("as"))), 6).alias("drift"))
