"""Column profiles: everything about single columns from one scan of wide aggregates, plus one stacked count of values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import number, string
from .quantiles import exact_quantiles

# Texts that stand for a missing value.
PLACEHOLDERS = ("?", "n/a", "na", "null", "none", "-", "unknown", "nan", "missing", "undefined", ".", "..", "...", "n.a.", "n.a", "#n/a", "#na", "not available", "not applicable")
# Value patterns, anchored.
PATTERNS = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
    "phone": r"^\+?[0-9][0-9 ().-]{6,18}[0-9]$",
    "url": r"^https?://[^ ]+$",
    "ssn": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "credit_card": r"^[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}$",
    "ipv4": r"^([0-9]{1,3}\.){3}[0-9]{1,3}$",
    "ipv6": r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    "zip": r"^[0-9]{5}(-[0-9]{4})?$",
    "date_iso": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    "date_us": r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$",
    "date_eu": r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}$",
}
TYPES = {
    "integer": r"^[+-]?[0-9]+(\.0*)?$",
    "float": r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": r"^(?i:true|false|yes|no)$",
    "date": r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}-[0-9]{2}-[0-9]{4})",
}


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def stacked(df: DataFrame, parts: dict[str, dict[str, Column]]) -> DataFrame:
    """column, and the named aggregates of each column: one aggregation, its row turned to a row for each column."""
    keys = list(dict.fromkeys(k for p in parts.values() for k in p))
    wide = df.agg(*(v.alias(f"c{i}_{k}") for i, p in enumerate(parts.values()) for k, v in p.items()))
    rows = [F.struct(F.lit(c).alias("column"), *((F.col(f"c{i}_{k}") if k in p else F.lit(None)).alias(k) for k in keys)) for i, (c, p) in enumerate(parts.items())]
    return wide.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def null_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    def of(c: str) -> dict[str, Column]:
        t = F.trim(string(c))
        return {"total": F.count(F.lit(1)), "nulls": F.count_if(_c(c).isNull()), "blanks": F.count_if(t == ""), "placeholders": F.count_if(F.lower(t).isin(*PLACEHOLDERS))}

    return stacked(df, {c: of(c) for c in columns})


LEVELS = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments from one scan; distinct counts and exact quantiles from counts of the values, spread over tasks."""

    def of(c: str) -> dict[str, Column]:
        x = number(c)
        return {"n": F.count(x), "low": F.round(F.min(x), 4), "high": F.round(F.max(x), 4), "mean": F.round(F.avg(x), 4), "sd": F.round(F.stddev_pop(x), 4)}

    pairs = F.array(*(F.struct(F.lit(c).alias("key"), number(c).cast("double").alias("x")) for c in columns))
    found = exact_quantiles(df.select(F.explode(pairs).alias("v")).select("v.*"), tuple(LEVELS.values()))
    found = found.select(F.col("key").alias("column"), "distinct", *(F.round(F.get("q", F.lit(i)), 4).alias(k) for i, k in enumerate(LEVELS)))
    moments = stacked(df, {c: of(c) for c in columns})
    return moments.join(found, "column", "left").select("column", "n", F.coalesce("distinct", F.lit(0)).alias("distinct"), "low", "high", "mean", "sd", *LEVELS)


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""

    def of(c: str) -> dict[str, Column]:
        x = number(c)
        n = F.count(x).cast("double")
        skew = F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)
        return {"skewness": F.round(skew, 4), "kurtosis": F.round(kurt, 4)}

    return stacked(df, {c: of(c) for c in columns})


def string_lengths(df: DataFrame, columns: list[str]) -> DataFrame:
    return stacked(df, {c: {"shortest": F.min(F.length(string(c))), "longest": F.max(F.length(string(c))), "mean": F.round(F.avg(F.length(string(c))), 4)} for c in columns})


def type_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values look like an integer, float, boolean or date, by the first that fits."""

    def of(c: str) -> dict[str, Column]:
        x = F.trim(string(c))
        kind = reduce(lambda w, k: w.when(x.rlike(TYPES[k]), k), TYPES, F.when(x.isNull(), "null"))
        kind = kind.otherwise("string")
        return {k: F.count_if(kind == k) for k in (*TYPES, "string", "null")}

    return stacked(df, {c: of(c) for c in columns})


def infer_type(counts: dict[str, int]) -> str:
    """The majority of the values; numbers with a twentieth of texts among them are texts."""
    seen = {k: v for k, v in counts.items() if k != "null" and v}
    if not seen:
        return "null"
    best = max(seen, key=lambda k: (seen[k], k))
    numeric = seen.get("integer", 0) + seen.get("float", 0)
    if best in ("integer", "float"):
        return "string" if seen.get("string", 0) >= 0.05 * sum(seen.values()) else "float" if seen.get("float", 0) >= 0.01 * numeric else "integer"
    return best


def pattern_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return stacked(df, {c: {k: F.count_if(string(c).rlike(p)) for k, p in PATTERNS.items()} for c in columns})


def card_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """How many values look like a card number, and how many of these pass the Luhn check."""
    card = lambda c: string(c).rlike(PATTERNS["credit_card"])
    return stacked(df, {c: {"cards": F.count_if(card(c)), "valid": F.count_if(F.when(card(c), luhn(string(c))))} for c in columns})


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value, n of all columns from one pass."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), string(c).alias("value")) for c in columns))
    return df.select(F.explode(pairs).alias("x")).select("x.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 10) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return value_counts(df, columns).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("column", "rank", "value", "n")


def char_pattern(x: Column) -> Column:
    """Digits as 9, letters as A, of the first 50 characters."""
    return F.regexp_replace(F.regexp_replace(F.left(x, F.lit(50)), "[0-9]", "9"), "[A-Za-z]", "A")


def compressed_pattern(x: Column) -> Column:
    """Runs of digits as 9+, of letters as A+."""
    return F.regexp_replace(F.regexp_replace(F.left(x, F.lit(50)), "[A-Za-z]+", "A+"), "[0-9]+", "9+")


def pattern_histogram(df: DataFrame, column: str, how=char_pattern) -> DataFrame:
    return df.where(_c(column).isNotNull()).groupBy(how(string(column)).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def format_anomalies(df: DataFrame, column: str, share: float = 0.9) -> DataFrame:
    """Patterns other than the dominant one, if one is dominant."""
    h = pattern_histogram(df, column, compressed_pattern)
    top = h.agg(F.max(F.struct("n", "pattern")).alias("top"), F.sum("n").alias("total"))
    return h.join(F.broadcast(top)).where((F.col("top.n") >= share * F.col("total")) & (F.col("pattern") != F.col("top.pattern"))).select("pattern", "n")


def quality_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """0.40 completeness + 0.35 validity + 0.25 consistency: values present, of the column's main type, of its main pattern."""
    kinds = type_counts(df, columns)
    main = F.greatest(*(F.col(k) for k in (*TYPES, "string")))
    full = reduce(lambda a, b: a + b, (F.col(k) for k in (*TYPES, "string")))
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), compressed_pattern(string(c)).alias("p")) for c in columns))
    top = df.select(F.explode(pairs).alias("x")).select("x.*").where("p IS NOT NULL").groupBy("column", "p").agg(F.count(F.lit(1)).alias("n")).groupBy("column").agg(F.max("n").alias("top"))
    out = kinds.join(top, "column", "left").select("column", full.alias("full"), (full + F.col("null")).alias("total"), main.alias("main"), F.coalesce("top", F.lit(0)).alias("top"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    parts = out.select("column", ratio("full", "total").alias("completeness"), ratio("main", "full").alias("validity"), ratio("top", "full").alias("consistency"))
    return parts.select("column", *(F.round(c, 4).alias(c) for c in ("completeness", "validity", "consistency")), F.round(100 * (0.4 * F.col("completeness") + 0.35 * F.col("validity") + 0.25 * F.col("consistency")), 4).alias("score"))


def histogram(df: DataFrame, column: str, bins: int = 20, log: bool = False) -> DataFrame:
    """bin (from 0), n: equal widths between the extremes, of log10 of the positive values if asked for."""
    x = number(column)
    rows = df.select((F.log10(x) if log else x).alias("x")).where("x IS NOT NULL" if not log else "x IS NOT NULL AND x > double('-infinity')")
    low, high = rows.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return rows.select(F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    slot = F.lit(0) if high == low else F.least(F.floor((F.col("x") - low) / ((high - low) / bins)), F.lit(bins - 1))
    return rows.groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def luhn(x: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    digits = F.transform(F.filter(F.split(F.reverse(F.regexp_replace(x, "[^0-9]", "")), ""), lambda d: d != ""), lambda d: d.cast("int"))
    total = F.aggregate(F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))), F.lit(0), lambda a, b: a + b)
    return (F.size(digits) > 0) & (total % 10 == 0)


def redact(x: Column) -> Column:
    """Masks e-mail addresses, numbers of the card kind and social security numbers within a text."""
    x = F.regexp_replace(x, r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})", "$1***@$2")
    x = F.regexp_replace(x, r"\b[0-9]{3}-[0-9]{2}-([0-9]{4})\b", "***-**-$1")
    return F.regexp_replace(x, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})\b", "****-****-****-$1")


# Words in column names that hint at personal data.
NAME_HINTS = {"email": ("email", "mail"), "phone": ("phone", "mobile", "tel"), "ssn": ("ssn", "social"), "credit_card": ("card", "ccnum"), "name": ("name",), "address": ("address", "street"), "date_of_birth": ("birth", "dob"), "ip": ("ip",), "zip": ("zip", "postal")}


LUHN_SHARE = 0.8


def privacy(df: DataFrame, columns: list[str], least: float = 0.5) -> list[dict]:
    """Columns with personal data: by the share of values that match, or by name (confidence 0.7).

    Card numbers count only where at least LUHN_SHARE of them pass the Luhn check.
    """
    out = []
    for r in pattern_counts(df, columns).join(null_kinds(df, columns), "column").join(card_counts(df, columns), "column").collect():
        full = r["total"] - r["nulls"]
        tokens = r["column"].lower().replace("-", "_").split("_")
        for kind in ("email", "phone", "ssn", "credit_card", "ipv4"):
            share = r[kind] / full if full else 0.0
            if share >= least and (kind != "credit_card" or r["valid"] >= LUHN_SHARE * r["cards"]):
                out.append({"column": r["column"], "kind": kind, "confidence": share})
        out += [{"column": r["column"], "kind": k, "confidence": 0.7} for k, words in NAME_HINTS.items() if any(w in tokens for w in words)]
    return out


def privacy_risk(found: list[dict], columns: int) -> tuple[float, str]:
    """0.4 highest + 0.3 mean confidence + 0.3 share of columns, in per cent, and its band."""
    if not found or not columns:
        return 0.0, "low"
    conf = [f["confidence"] for f in found]
    score = 100 * (0.4 * max(conf) + 0.3 * sum(conf) / len(conf) + 0.3 * len({f["column"] for f in found}) / columns)
    return score, "critical" if score >= 70 else "high" if score >= 50 else "medium" if score >= 30 else "low"


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))
