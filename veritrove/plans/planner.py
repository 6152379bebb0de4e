"""The planner: all row and scalar rules of a table in one fused aggregation, the phase that needs statistics in a second, and
jobs of their own only for rules that join or group. Only scalars reach the driver."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import file_rules, field_rules, set_rules, stat_rules  # noqa: F401  fills the registry
from ..operators.base import Context, Outcome, Rule, RuleError, count_true

#: Aggregates to a scan; generated methods have a size limit.
WIDTH = 150
RESULT = T.StructType(
    [T.StructField("rule", T.StringType()), T.StructField("total_count", T.LongType()), T.StructField("failed_count", T.LongType()), T.StructField("passed", T.BooleanType())]
)


def _scan(df: DataFrame, wanted: dict[str, Any]) -> dict[str, Any]:
    """Values of named aggregates, WIDTH to a scan."""
    out: dict[str, Any] = {}
    names = list(wanted)
    for i in range(0, len(names), WIDTH):
        row = df.agg(*(wanted[n].alias(n) for n in names[i : i + WIDTH])).first()
        out |= row.asDict()
    return out


def _first_phase(df: DataFrame, rules: dict[int, Rule]) -> dict[str, Any]:
    wanted = {}
    for i, r in rules.items():
        if r.kind == "row":
            scope = r.scope(df)
            wanted[f"r{i}_bad"] = count_true(r.bad(df) & scope if scope is not None else r.bad(df))
            wanted[f"r{i}_n"] = count_true(scope) if scope is not None else F.count(F.lit(1))
        elif r.kind in ("scalar", "phased"):
            wanted |= {f"r{i}_{k}": v for k, v in r.metrics(df).items()}
    return wanted


def _of(values: dict[str, Any], i: int) -> dict[str, Any]:
    return {k[len(f"r{i}_") :]: v for k, v in values.items() if k.startswith(f"r{i}_")}


def outcomes(df: DataFrame, rules: list[Rule], ctx: Context) -> list[Outcome]:
    """One outcome a rule, in order. A rule that cannot be bound or run fails with a message; the others go on."""
    found: list[Outcome | None] = [None] * len(rules)
    sound = []
    for i, r in enumerate(rules):
        try:
            r.bind(df)
            r.scope(df)
            if r.kind == "row":
                r.bad(df)
            elif r.kind in ("scalar", "phased"):
                r.metrics(df)
            sound.append(i)
        except (RuleError, ValueError) as e:
            found[i] = Outcome(0, 0, False, f"{type(e).__name__}: {e}")
    values = _scan(df, _first_phase(df, {i: rules[i] for i in sound}))
    values |= _scan(df, {f"r{i}_{k}": v for i in sound if rules[i].kind == "phased" for k, v in rules[i].second(df, _of(values, i)).items()})
    for i in sound:
        r, v = rules[i], _of(values, i)
        if r.kind == "row":
            found[i] = Outcome(v["bad"], v["n"] * r.weight(), v["bad"] == 0)
        elif r.kind in ("scalar", "phased"):
            found[i] = r.judge(v)
        else:
            try:
                found[i] = r.run(df, ctx)
            except (RuleError, FileNotFoundError) as e:
                found[i] = Outcome(0, 0, False, f"{type(e).__name__}: {e}")
    return [o for o in found if o is not None]


def samples(df: DataFrame, rule: Rule, most: int = 100) -> DataFrame:
    """Some violating rows of a row rule; asked for only after counts have shown failures."""
    scope = rule.scope(df)
    return df.where(rule.bad(df) if scope is None else rule.bad(df) & scope).limit(most)


def results(df: DataFrame, rules: list[Rule], ctx: Context, names: list[str] | None = None) -> DataFrame:
    """rule, total_count, failed_count, passed: a row for each rule."""
    rows = [(n, o.total, o.failed, o.passed) for n, o in zip(names or [r.name for r in rules], outcomes(df, rules, ctx), strict=True)]
    return ctx.spark.createDataFrame(rows, RESULT)
