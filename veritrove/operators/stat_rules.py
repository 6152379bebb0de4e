"""Statistical and temporal rules. Statistics of all such rules come from one scan, counts that need them from a second."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import number
from ..functions.tails import correlation_tail, kolmogorov_tail
from .base import Outcome, Rule, RuleError, count_true
from .quantiles import quantiles
from .set_rules import _Reference, _reference, scalar


def fences(q1: float, q3: float, k: float) -> tuple[float, float]:
    return q1 - k * (q3 - q1), q3 + k * (q3 - q1)


class _Outliers(Rule):
    kind = "phased"

    def x(self, df: DataFrame) -> Column:
        return self.in_scope(df, number(self.p.get("field") or self.p.get("column")))

    def metrics(self, df):
        x, m = self.x(df), self.p["method"]
        out = {"n": F.count(x)}
        if m == "zscore":
            out |= {"mean": F.avg(x), "sd": F.stddev_pop(x)}
        return out

    def second(self, df, v):
        x, t = self.x(df), float(self.p["threshold"] if self.p["threshold"] is not None else self.DEFAULT[self.p["method"]])
        if not v["n"]:
            return {}
        if self.p["method"] == "zscore":
            return {"bad": count_true(F.abs(x - v["mean"]) > t * v["sd"])} if v["sd"] else {}
        if self.p["method"] == "iqr":
            q = quantiles(df, x, (0.25, 0.75))
            low, high = fences(*q, t)
            return {"bad": count_true((x < low) | (x > high))} if q[0] != q[1] or self.FLAT else {}
        median = quantiles(df, x, (0.5,))[0]
        mad = quantiles(df, F.abs(x - median), (0.5,))[0]
        return {"bad": count_true(F.abs(0.6745 * (x - median) / mad) > t)} if mad else {}

    DEFAULT = {"zscore": 3.0, "iqr": 1.5, "modified_zscore": 3.5}
    FLAT = False


class StatisticalOutlierCheck(_Outliers):
    """|z| over the threshold (population deviation), or outside of the quartile fences. No numbers at all: fails."""

    REQUIRED = ("field",)
    PARAMS = {"method": "zscore", "threshold": None}

    def check(self):
        if self.p["method"] not in ("zscore", "iqr"):
            raise RuleError(f"method {self.p['method']!r}")

    def judge(self, v):
        bad = v.get("bad") or 0
        return Outcome(bad, v["n"], bool(v["n"]) and bad == 0)


class AdvancedAnomalyDetectionCheck(_Outliers):
    """The share of anomalies is at most max_anomaly_pct."""

    REQUIRED = ("column", "method")
    PARAMS = {"threshold": None, "max_anomaly_pct": 5.0}
    FLAT = True

    def check(self):
        if self.p["method"] == "isolation_forest":
            self.kind = "plan"
        elif self.p["method"] not in self.DEFAULT:
            raise RuleError(f"method {self.p['method']!r}")

    def run(self, df, ctx):
        from .forest import isolation_scores

        scored = isolation_scores(self.scoped(df).select(number(self.p["column"]).alias("x")).dropna(), ["x"])
        n, bad = scored.agg(F.count(F.lit(1)), F.count_if(F.col("anomaly"))).first()
        return Outcome(bad, n, (100.0 * bad / n if n else 0.0) <= float(self.p["max_anomaly_pct"]))

    def judge(self, v):
        bad = v.get("bad") or 0
        pct = 100.0 * bad / v["n"] if v["n"] else 0.0
        return Outcome(bad, v["n"], pct <= float(self.p["max_anomaly_pct"]), details={"pct": pct})


def cdf(kind: str, x: Column, a: float, b: float) -> Column:
    """A closed-form distribution function; the normal one by the rational erf approximation of 7.1.26 in the handbook of
    Abramowitz and Stegun (error under 1.5e-7)."""
    if kind == "uniform":
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - a) / (b - a)))
    if kind == "exponential":
        return F.when(x < 0, 0.0).otherwise(1 - F.exp(-x / a))
    z = F.abs((x - a) / (b * math.sqrt(2)))
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return 0.5 * (1 + F.when(x >= a, erf).otherwise(-erf))


def below(edges: list[float], x: Column) -> Column:
    """How many of the ascending edges are smaller than x, by halving steps: a scan of all would cost each value as many steps as there are slots."""
    held = F.array(*map(F.lit, edges))
    steps = F.array(*(F.lit(1 << k) for k in range(len(edges).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when(F.coalesce(F.get(held, n + k - 1) < x, F.lit(False)), n + k).otherwise(n))


def running_counts(values: DataFrame) -> DataFrame:
    """x, n, before: for each distinct value how often it occurs and how many are smaller.

    Distinct values go to slots between approximate quantiles (1024 at most), are counted within slots, and the slots' totals
    are added: no single task sees all.
    """
    n = values.count()
    if not n:
        return values.select("x", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("before")).limit(0)
    slots = max(1, min(1024, n // 20_000))
    edges = sorted(set(values.agg(F.percentile_approx("x", [i / slots for i in range(1, slots)], 10_000)).first()[0])) if slots > 1 else []
    slot = below(edges, F.col("x")) if edges else F.lit(0)
    counts = values.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("p", slot)
    totals = counts.groupBy("p").agg(F.sum("n").alias("t"))
    before = totals.select("p", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(before, "p").select("x", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))


def ks_statistic(df: DataFrame, column: str, kind: str) -> tuple[float | None, int]:
    x = df.select(number(column).alias("x")).dropna()
    n, mean, sd, low, high = x.agg(F.count("x"), F.avg("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()
    if not n or (kind == "normal" and not sd) or (kind == "uniform" and low == high) or (kind == "exponential" and not mean):
        return None, n
    f = cdf(kind, F.col("x"), *{"normal": (mean, sd), "uniform": (low, high), "exponential": (mean, 0.0)}[kind])
    gap = F.greatest((F.col("before") + F.col("n")) / n - f, f - F.col("before") / n)
    return running_counts(x).agg(F.max(gap)).first()[0], n


class DistributionCheck(Rule):
    """Kolmogorov-Smirnov against a fitted normal, uniform or exponential; passes if p is over the significance level."""

    kind = "plan"
    REQUIRED = ("column", "expected_distribution")
    PARAMS = {"significance_level": 0.05, "min_sample_size": 30}

    def check(self):
        if self.p["expected_distribution"] not in ("normal", "uniform", "exponential"):
            raise RuleError(f"distribution {self.p['expected_distribution']!r}")

    def run(self, df, ctx):
        d, n = ks_statistic(self.scoped(df), self.p["column"], self.p["expected_distribution"])
        if n < int(self.p["min_sample_size"]) or d is None:
            return Outcome(1, n, False, "too few values")
        p = kolmogorov_tail(d, n)
        ok = p > float(self.p["significance_level"])
        return Outcome(int(not ok), n, ok, details={"d": d, "p": p})


def average_ranks(df: DataFrame, column: str) -> DataFrame:
    """x -> its average rank, by value."""
    return running_counts(df.select(F.col(column).alias("x"))).select(F.col("x").alias(column), (F.col("before") + (F.col("n") + 1) / 2).alias(f"rank_{column}"))


class CorrelationCheck(Rule):
    """A correlation of two columns against bounds or an expected value; at least three pairs."""

    kind = "plan"
    REQUIRED = ("column1", "column2")
    PARAMS = {"expected_correlation": None, "min_correlation": None, "max_correlation": None, "correlation_type": "pearson", "tolerance": 0.1}

    def check(self):
        if self.p["correlation_type"] not in ("pearson", "spearman", "kendall"):
            raise RuleError(f"correlation_type {self.p['correlation_type']!r}")

    def run(self, df, ctx):
        pairs = self.scoped(df).select(number(self.p["column1"]).alias("a"), number(self.p["column2"]).alias("b")).dropna()
        how = self.p["correlation_type"]
        if how == "spearman":
            pairs = pairs.join(average_ranks(pairs, "a"), "a").join(average_ranks(pairs, "b"), "b").select(F.col("rank_a").alias("a"), F.col("rank_b").alias("b"))
        n, r = pairs.agg(F.count(F.lit(1)), F.corr("a", "b")).first()
        if how == "kendall":
            r = kendall(pairs)
        if n < 3 or r is None or math.isnan(r):
            return Outcome(1, n, False, "too few pairs")
        e, low, high = self.p["expected_correlation"], self.p["min_correlation"], self.p["max_correlation"]
        ok = (e is None or abs(r - e) <= self.p["tolerance"]) and (low is None or r >= low) and (high is None or r <= high)
        return Outcome(int(not ok), n, ok, details={"r": r, "p": correlation_tail(r, n)})


SLOT = 4096


def kendall(pairs: DataFrame) -> float | None:
    """tau-b of all rows (a, b), by counts of distinct pairs.

    Two values of b, as numbers of smaller rows, part at one bit: above it they agree (a block), and there one has 0, the other 1.
    So for each bit, rows with 1 are compared with the rows with 0 of their block, of which running sums by a tell how many are
    smaller and greater in a. The sums run within slots of a that hold SLOT rows, and over the slots' totals.
    """
    n = pairs.count()
    if n < 2:
        return None
    ties = lambda c: F.sum((F.col(c) * (F.col(c) - 1)).cast("decimal(38,0)"))
    by_a, by_b = (running_counts(pairs.select(F.col(c).alias("x"))) for c in ("a", "b"))
    ties_a, ties_b = (int(t.agg(ties("n")).first()[0]) for t in (by_a, by_b))
    if n * (n - 1) in (ties_a, ties_b):
        return None
    cells = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    cells = cells.join(by_a.select(F.col("x").alias("a"), F.col("before").alias("p")), "a").join(by_b.select(F.col("x").alias("b"), F.col("before").alias("q")), "b")
    dealt = cells.select("p", "q", "w", F.explode(F.sequence(F.lit(0), F.lit((n - 1).bit_length() - 1))).alias("h"))
    one = F.expr("shiftright(q, h) & 1") == 1
    count = lambda c: F.sum(F.when(c, F.col("w")).otherwise(0))
    at = dealt.groupBy("h", F.expr("shiftright(q, h + 1)").alias("block"), "p").agg(count(~one).alias("zeros"), count(one).alias("ones")).withColumn("slot", F.floor(F.col("p") / SLOT))
    slots = at.groupBy("h", "block", "slot").agg(F.sum("zeros").alias("t"))
    over = Window.partitionBy("h", "block")
    slots = slots.select("h", "block", "slot", F.sum("t").over(over).alias("all"), (F.sum("t").over(over.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("base"))
    inside = Window.partitionBy("h", "block", "slot").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    smaller = F.col("base") + F.sum("zeros").over(inside) - F.col("zeros")
    found = at.join(slots, ["h", "block", "slot"]).select("ones", (2 * smaller + F.col("zeros") - F.col("all")).alias("d"))
    ahead = int(found.agg(F.sum(F.col("ones").cast("decimal(19,0)") * F.col("d").cast("decimal(19,0)"))).first()[0])
    return 2 * ahead / math.sqrt(n * (n - 1) - ties_a) / math.sqrt(n * (n - 1) - ties_b)


class BaselineComparisonCheck(_Reference):
    """A metric against the mean of a baseline's values in the days before the clock (all, if there are none)."""

    REQUIRED = ("metric", "baseline_file")
    PARAMS = {"column": None, "lookback_days": 30, "tolerance_pct": 10.0, "date_column": "date", "value_column": "value"}

    def run(self, df, ctx):
        now = scalar(self.scoped(df), self.p["metric"], self.p["column"])
        base = _reference(ctx, self.p["baseline_file"])
        clock = F.to_timestamp(F.lit(str(ctx.now))) if ctx.now else F.current_timestamp()
        recent = F.datediff(clock, F.col(self.p["date_column"]).cast("timestamp")).between(0, int(self.p["lookback_days"]))
        value = F.col(self.p["value_column"]).try_cast("double")
        a, b = base.agg(F.avg(F.when(recent, value)), F.avg(value)).first()
        mean = a if a is not None else b
        if now is None or not mean:
            return Outcome(1, 1, False, "no baseline")
        delta = 100.0 * abs(now - mean) / abs(mean)
        ok = delta <= float(self.p["tolerance_pct"])
        return Outcome(int(not ok), 1, ok, details={"delta_pct": delta, "value": now, "baseline": mean})


class TrendDetectionCheck(_Reference):
    """Growth or decline against the baseline value nearest to the clock less the period, within a day."""

    REQUIRED = ("metric", "baseline_file")
    PARAMS = {"column": None, "max_growth_pct": None, "max_decline_pct": None, "comparison_period": 1, "date_column": "date", "value_column": "value"}

    def check(self):
        if self.p["metric"] not in ("count", "sum", "mean"):
            raise RuleError("metric is count, sum or mean")

    def run(self, df, ctx):
        now = scalar(self.scoped(df), self.p["metric"], self.p["column"])
        clock = F.to_timestamp(F.lit(str(ctx.now))) if ctx.now else F.current_timestamp()
        gap = F.abs(F.datediff(F.date_sub(clock, int(self.p["comparison_period"])), F.col(self.p["date_column"]).cast("timestamp")))
        near = _reference(ctx, self.p["baseline_file"]).select(gap.alias("gap"), F.col(self.p["value_column"]).try_cast("double").alias("v")).where("gap <= 1").orderBy("gap", "v").limit(1).collect()
        if now is None or not near or not near[0]["v"]:
            return Outcome(1, 1, False, "no baseline near the date")
        change = 100.0 * (now - near[0]["v"]) / abs(near[0]["v"])
        up, down = self.p["max_growth_pct"], self.p["max_decline_pct"]
        ok = (up is None or change <= up) and (down is None or -change <= down)
        return Outcome(int(not ok), 1, ok, details={"change_pct": change})


def gaps(df: DataFrame, field: str) -> DataFrame:
    """Seconds between consecutive distinct times, without a global window: bounds of day buckets are joined on."""
    t = df.select(F.col(f"`{field}`").cast("timestamp").alias("t")).dropna().distinct().withColumn("d", F.to_date("t"))
    inside = t.withColumn("prev", F.lag("t").over(Window.partitionBy("d").orderBy("t")))
    days = t.groupBy("d").agg(F.max("t").alias("last"))
    before = days.select("d", F.lag("last").over(Window.orderBy("d")).alias("carry"))
    return inside.join(before, "d").select("t", (F.unix_micros("t") - F.unix_micros(F.coalesce("prev", "carry"))).alias("us")).where("us IS NOT NULL").select("t", (F.col("us") / 1e6).alias("seconds"))


class TemporalFrequencyCheck(Rule):
    """Intervals lie within the tolerance of the expected frequency (or of their median)."""

    kind = "plan"
    REQUIRED = ("field",)
    PARAMS = {"expected_frequency": None, "tolerance": 0.2}
    SECONDS = {"secondly": 1, "minutely": 60, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2629746, "quarterly": 7889238, "yearly": 31556952}

    def run(self, df, ctx):
        g = gaps(self.scoped(df), self.p["field"])
        e = self.p["expected_frequency"]
        base = self.SECONDS[e] if e else (quantiles(g, F.col("seconds"), (0.5,)) or [None])[0]
        if base is None:
            return Outcome(0, 0, True)
        n, bad = g.agg(F.count(F.lit(1)), F.count_if(F.abs(F.col("seconds") - base) > float(self.p["tolerance"]) * base)).first()
        return Outcome(bad, n, bad == 0, details={"base_seconds": float(base)})


class TemporalGapCheck(Rule):
    """Consecutive times are at most max_gap seconds apart."""

    kind = "plan"
    REQUIRED = ("field", "max_gap")

    def run(self, df, ctx):
        n, bad = gaps(self.scoped(df), self.p["field"]).agg(F.count(F.lit(1)), F.count_if(F.col("seconds") > float(self.p["max_gap"]))).first()
        return Outcome(bad, n, bad == 0)
