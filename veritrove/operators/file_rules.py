"""Rules about files and schemas. File facts come from Hadoop's file system API, so any store that Spark reads will do."""

from __future__ import annotations

import csv
import io

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.readers import file_status
from .base import Outcome, Rule, RuleError

# Logical type groups of schema checks.
GROUPS = {
    "string": (T.StringType, T.CharType, T.VarcharType),
    "integer": (T.ByteType, T.ShortType, T.IntegerType, T.LongType),
    "float": (T.FloatType, T.DoubleType, T.DecimalType),
    "number": (T.NumericType,),
    "date": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
    "any": (T.DataType,),
}


class EmptyFileCheck(Rule):
    kind = "plan"
    PARAMS = {"check_data_rows": False}

    def run(self, df, ctx):
        size = file_status(ctx.spark, ctx.path)["bytes"] if ctx.path else None
        empty = size == 0 or ((self.p["check_data_rows"] or size is None) and df.isEmpty())
        return Outcome(int(empty), 1, not empty, details={"bytes": size})


class FileSizeCheck(Rule):
    kind = "plan"
    PARAMS = {"min_size_mb": None, "max_size_mb": None, "max_size_gb": None}

    def run(self, df, ctx):
        if not ctx.path:
            raise RuleError("FileSizeCheck needs a file")
        mb = file_status(ctx.spark, ctx.path)["bytes"] / 2**20
        high = self.p["max_size_gb"] * 1024 if self.p["max_size_gb"] is not None else self.p["max_size_mb"]
        wrong = (self.p["min_size_mb"] is not None and mb < self.p["min_size_mb"]) or (high is not None and mb > high)
        return Outcome(int(wrong), 1, not wrong, details={"mb": mb})


class CSVFormatCheck(Rule):
    """Rows of another width than the first; passes with few errors that are under a tenth of the rows."""

    kind = "plan"
    PARAMS = {"delimiter": None, "sample_rows": 1000, "max_errors": 10}

    def run(self, df, ctx):
        from ..sources.readers import head_bytes, sniff_delimiter

        if not ctx.path:
            raise RuleError("CSVFormatCheck needs a file")
        sep = self.p["delimiter"] or sniff_delimiter(head_bytes(ctx.spark, ctx.path).decode("utf-8", "replace"))
        lines = [r["value"] for r in ctx.spark.read.text(ctx.path).limit(int(self.p["sample_rows"])).collect()]
        widths = [len(row) for row in csv.reader(io.StringIO("\n".join(lines)), delimiter=sep)]
        bad = sum(w != widths[0] for w in widths[1:])
        return Outcome(bad, len(widths), bool(widths) and bad <= int(self.p["max_errors"]) and bad < 0.1 * len(widths))


class SchemaMatchCheck(Rule):
    kind = "plan"
    REQUIRED = ("expected_schema",)
    PARAMS = {"strict": False, "check_order": False}

    def run(self, df, ctx):
        want, have = self.p["expected_schema"], df.columns
        if unknown := [t for t in want.values() if t not in GROUPS]:
            raise RuleError(f"unknown types {unknown}")
        issues = {
            "missing": [c for c in want if c not in have],
            "extra": [c for c in have if c not in want] if self.p["strict"] else [],
            "order": [c for c in want if c in have] != [c for c in have if c in want] if self.p["check_order"] else False,
            "types": [c for c, t in want.items() if c in have and not isinstance(df.schema[c].dataType, GROUPS[t])],
        }
        n = sum(bool(x) for x in issues.values())
        return Outcome(n, len(want), n == 0, details=issues)


class ColumnPresenceCheck(Rule):
    kind = "plan"
    REQUIRED = ("required_columns",)
    PARAMS = {"case_sensitive": True}

    def run(self, df, ctx):
        fold = (lambda x: x) if self.p["case_sensitive"] else str.lower
        have = {fold(c) for c in df.columns}
        lacking = [c for c in self.p["required_columns"] if fold(c) not in have]
        return Outcome(len(lacking), len(self.p["required_columns"]), not lacking, details={"missing": lacking})


class FreshnessCheck(Rule):
    """The file's change time, or the newest date in the data, is at most max_age_hours before the clock."""

    kind = "plan"
    REQUIRED = ("max_age_hours",)
    PARAMS = {"check_type": "file", "date_field": None}

    def run(self, df, ctx):
        clock = F.to_timestamp(F.lit(str(ctx.now))) if ctx.now else F.current_timestamp()
        if self.p["check_type"] == "data":
            then = F.max(F.col(f"`{self.p['date_field']}`").cast("timestamp"))
            hours = self.scoped(df).agg(((F.unix_micros(clock) - F.unix_micros(then)) / 3.6e9).alias("h")).first()["h"]
        else:
            then = file_status(ctx.spark, ctx.path)["modified_ms"]
            hours = ctx.spark.range(1).select((F.unix_micros(clock) / 1000 - F.lit(then)).alias("ms")).first()["ms"] / 3.6e6
        old = hours is None or hours > float(self.p["max_age_hours"])
        return Outcome(int(old), 1, not old, details={"age_hours": hours})
