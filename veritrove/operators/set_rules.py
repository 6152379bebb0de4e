"""Rules that group or join: keys, duplicates, references and SQL. Membership is a semi or anti join, so Spark picks
broadcast or sort-merge by the sizes it measures; composite keys stay columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import number
from .base import Context, Outcome, Rule, RuleError


def _names(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _keys(df: DataFrame, names: list[str], rename: list[str] | None = None) -> DataFrame:
    return df.select(*(F.col(f"`{c}`").alias(r) for c, r in zip(names, rename or names, strict=True)))


def surplus(df: DataFrame, keys: list[str], drop_null: bool) -> tuple[int, int]:
    """Occurrences after the first of each key, and rows looked at."""
    rows = _keys(df, keys, [f"k{i}" for i in range(len(keys))])
    if drop_null:
        rows = rows.dropna()
    groups = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    out = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("s"), F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()
    return out["s"], out["t"]


class UniqueKeyCheck(Rule):
    """Keys repeat; rows with a null in the key are left out."""

    kind = "plan"
    REQUIRED = ("fields",)

    def columns(self):
        return _names(self.p["fields"])

    def run(self, df, ctx):
        n, _ = surplus(self.scoped(df), _names(self.p["fields"]), True)
        return Outcome(n, self.scoped(df).count(), n == 0)


class DuplicateRowCheck(Rule):
    """Rows repeat in the key fields (or all); nulls are equal."""

    kind = "plan"
    PARAMS = {"key_fields": None, "consider_all_fields": False}

    def check(self):
        if not self.p["key_fields"] and not self.p["consider_all_fields"]:
            raise RuleError("DuplicateRowCheck needs key_fields or consider_all_fields")

    def columns(self):
        return _names(self.p["key_fields"] or ())

    def run(self, df, ctx):
        n, total = surplus(self.scoped(df), df.columns if self.p["consider_all_fields"] else _names(self.p["key_fields"]), False)
        return Outcome(n, total, n == 0)


def _reference(ctx: Context, name: str, form: str | None = None) -> DataFrame:
    from ..sources.readers import load, resolve

    return ctx.tables[name] if name in ctx.tables else load(ctx.spark, resolve(ctx.spark, name, ctx.path, ctx.base_path), form)


class _Reference(Rule):
    kind = "plan"


class ReferentialIntegrityCheck(_Reference):
    """Foreign keys that the reference lacks; null keys too unless allowed."""

    REQUIRED = ("foreign_key", "reference_file", "reference_key")
    PARAMS = {"allow_null": False, "reference_file_format": None}

    def columns(self):
        return _names(self.p["foreign_key"])

    def run(self, df, ctx):
        own = _names(self.p["foreign_key"])
        keys = [f"k{i}" for i in range(len(own))]
        rows = _keys(self.scoped(df), own, keys)
        ref = _keys(_reference(ctx, self.p["reference_file"], self.p["reference_file_format"]), _names(self.p["reference_key"]), keys).dropna().distinct()
        total, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.greatest(*(F.col(k).isNull() for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull())).first()
        orphans = rows.dropna().join(ref, keys, "left_anti").count()
        failed = orphans + (0 if self.p["allow_null"] else nulls)
        return Outcome(failed, total, failed == 0, details={"orphans": orphans, "nulls": nulls})


class CrossFileKeyCheck(_Reference):
    """Keys against a reference: exact_match, subset, overlap (a least share of keys), superset (every reference key occurs)."""

    REQUIRED = ("foreign_key", "reference_file", "reference_key")
    PARAMS = {"check_mode": "exact_match", "allow_null": False, "min_overlap_pct": 1.0, "reference_file_format": None}

    def check(self):
        if self.p["check_mode"] not in ("exact_match", "subset", "overlap", "superset"):
            raise RuleError(f"check_mode {self.p['check_mode']!r}")

    def columns(self):
        return _names(self.p["foreign_key"])

    def run(self, df, ctx):
        mode = self.p["check_mode"]
        if mode in ("exact_match", "subset"):
            inner = ReferentialIntegrityCheck(foreign_key=self.p["foreign_key"], reference_file=self.p["reference_file"], reference_key=self.p["reference_key"], allow_null=self.p["allow_null"] and mode != "subset", reference_file_format=self.p["reference_file_format"])
            return inner.run(self.scoped(df), ctx)
        own = _names(self.p["foreign_key"])
        names = [f"k{i}" for i in range(len(own))]
        keys = _keys(self.scoped(df), own, names).dropna().distinct()
        ref = _keys(_reference(ctx, self.p["reference_file"], self.p["reference_file_format"]), _names(self.p["reference_key"]), names).dropna().distinct()
        if mode == "overlap":
            total, common = keys.count(), keys.join(ref, names, "left_semi").count()
            share = 100.0 * common / total if total else 0.0
            return Outcome(total - common, total, bool(total) and share >= float(self.p["min_overlap_pct"]), details={"overlap_pct": share})
        total, lacking = ref.count(), ref.join(keys, names, "left_anti").count()
        return Outcome(lacking, total, bool(total) and lacking == 0)


class CrossFileDuplicateCheck(_Reference):
    """Rows whose key occurs in any of the references."""

    REQUIRED = ("columns", "reference_files")
    PARAMS = {"reference_file_format": None}

    def columns(self):
        return _names(self.p["columns"])

    def run(self, df, ctx):
        names = _names(self.p["columns"])
        refs = [_keys(_reference(ctx, r, self.p["reference_file_format"]), names) for r in _names(self.p["reference_files"])]
        union = refs[0]
        for r in refs[1:]:
            union = union.unionByName(r)
        rows = _keys(self.scoped(df), names)
        n = rows.join(union.dropna().distinct(), names, "left_semi").count()
        return Outcome(n, rows.count(), n == 0)


AGGREGATES = {"count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max}
COMPARISONS = {"==": lambda a, b, t: abs(a - b) <= t, "!=": lambda a, b, t: abs(a - b) > t, ">": lambda a, b, t: a > b - t, "<": lambda a, b, t: a < b + t, ">=": lambda a, b, t: a >= b - t, "<=": lambda a, b, t: a <= b + t}


def scalar(df: DataFrame, how: str, column: str | None) -> float | None:
    if how not in AGGREGATES or (how != "count" and not column):
        raise RuleError(f"aggregation {how!r} of {column!r}")
    x: Column = F.lit(1) if how == "count" else number(column)
    got = df.agg(AGGREGATES[how](x)).first()[0]
    return None if got is None else float(got)


class CrossFileComparisonCheck(_Reference):
    """An aggregate against the reference's; a percentage tolerance overrides an absolute one."""

    REQUIRED = ("aggregation", "comparison", "reference_file")
    PARAMS = {"column": None, "reference_aggregation": None, "reference_column": None, "tolerance": 0.0, "tolerance_pct": None, "reference_file_format": None}

    def check(self):
        if self.p["comparison"] not in COMPARISONS:
            raise RuleError(f"comparison {self.p['comparison']!r}")

    def run(self, df, ctx):
        a = scalar(self.scoped(df), self.p["aggregation"], self.p["column"])
        b = scalar(_reference(ctx, self.p["reference_file"], self.p["reference_file_format"]), self.p["reference_aggregation"] or self.p["aggregation"], self.p["reference_column"] or self.p["column"])
        if a is None or b is None:
            return Outcome(1, 1, False, "no value to compare")
        room = abs(b) * float(self.p["tolerance_pct"]) / 100 if self.p["tolerance_pct"] is not None else float(self.p["tolerance"])
        ok = COMPARISONS[self.p["comparison"]](a, b, room)
        return Outcome(int(not ok), 1, ok, details={"value": a, "reference": b})


class SQLCustomCheck(Rule):
    """Every row that the query returns is a failure. Views are the context's tables, or a JDBC source."""

    kind = "plan"
    REQUIRED = ("sql_query",)
    PARAMS = {"connection_string": None, "max_sample_size": 10, "constraint_name": None}

    def run(self, df, ctx):
        from ..sources.jdbc import guarded_query, read_query

        query = guarded_query(self.p["sql_query"])
        if self.p["connection_string"]:
            n = read_query(ctx.spark, self.p["connection_string"], query).count()
        else:
            n = ctx.spark.sql(query, **{k: v for k, v in {"data": df, **ctx.tables}.items() if "{" + k + "}" in query}).count()
        return Outcome(n, n, n == 0)


class DatabaseConstraintCheck(Rule):
    """As SQLCustomCheck, for a named constraint of a table."""

    kind = "plan"
    REQUIRED = ("table", "constraint_query")
    PARAMS = {"connection_string": None, "constraint_name": None}

    def run(self, df, ctx):
        from ..sources.jdbc import identifier

        identifier(self.p["table"])
        return SQLCustomCheck(sql_query=self.p["constraint_query"], connection_string=self.p["connection_string"]).run(df, ctx)


class DatabaseReferentialIntegrityCheck(Rule):
    """Foreign keys of one table that another lacks; nulls too unless allowed."""

    kind = "plan"
    REQUIRED = ("foreign_key_table", "foreign_key_column", "reference_table", "reference_key_column")
    PARAMS = {"connection_string": None, "allow_null": False}

    def run(self, df, ctx):
        from ..sources.jdbc import read_table

        def get(t):
            return ctx.tables[t] if t in ctx.tables else read_table(ctx.spark, self.p["connection_string"], t) if self.p["connection_string"] else ctx.spark.table(t)

        tables = {"__ref": get(self.p["reference_table"])}
        inner = ReferentialIntegrityCheck(foreign_key=self.p["foreign_key_column"], reference_file="__ref", reference_key=self.p["reference_key_column"], allow_null=self.p["allow_null"])
        return inner.run(get(self.p["foreign_key_table"]), Context(ctx.spark, tables=tables))
