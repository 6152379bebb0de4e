"""What a rule is, and the registry of rules.

A rule compiles to one of:
  row      bad(df) -> never-null boolean Column; counted in the fused scan
  scalar   metrics(df) -> {name: aggregate Column}, judge(values) -> Outcome; part of the fused scan
  phased   like scalar, then second(values) -> aggregate Columns of a second fused scan, judge(values of both)
  plan     run(df, ctx) -> Outcome by jobs of its own (joins, grouped counts)
  meta     inspect(df, ctx) -> Outcome from the schema or the file alone
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import predicate


class RuleError(ValueError):
    """A rule with missing, unknown or invalid parameters."""


@dataclass(frozen=True)
class Context:
    """Where the data came from, how to load references, and the clock."""

    spark: SparkSession
    name: str = "data"
    path: str | None = None
    base_path: str | None = None
    format: str | None = None
    now: Any = None
    tables: dict[str, DataFrame] = field(default_factory=dict)
    most_samples: int = 100


@dataclass(frozen=True)
class Outcome:
    failed: int
    total: int
    passed: bool
    message: str = ""
    details: dict[str, Any] = field(default_factory=dict)


REGISTRY: dict[str, type[Rule]] = {}


class Rule:
    """Base of all rules. Subclasses name their parameters with defaults in PARAMS (REQUIRED: no default)."""

    kind = "row"
    PARAMS: dict[str, Any] = {}
    REQUIRED: tuple[str, ...] = ()

    def __init__(self, severity: str = "ERROR", condition: str | None = None, **params: Any):
        unknown = set(params) - set(self.PARAMS) - set(self.REQUIRED)
        missing = [p for p in self.REQUIRED if params.get(p) is None]
        if unknown or missing:
            raise RuleError(f"{type(self).__name__}: unknown {sorted(unknown)}, missing {missing}")
        if severity not in ("ERROR", "WARNING"):
            raise RuleError(f"severity {severity!r}")
        self.severity, self.condition, self.p = severity, condition, {**self.PARAMS, **params}
        self.check()

    def __init_subclass__(cls, **kw: Any):
        super().__init_subclass__(**kw)
        if not cls.__name__.startswith("_"):
            REGISTRY[cls.__name__] = cls

    @property
    def name(self) -> str:
        return type(self).__name__

    def check(self) -> None:
        """Raises RuleError if parameters do not fit together."""

    def columns(self) -> list[str]:
        """Columns that must exist."""
        return [c for k in ("field", "column", "field_a", "field_b", "column1", "column2") if isinstance(c := self.p.get(k), str)]

    def bind(self, df: DataFrame) -> None:
        lacking = [c for c in self.columns() if c not in df.columns]
        if lacking:
            raise RuleError(f"{self.name}: no column {', '.join(lacking)}")

    def scope(self, df: DataFrame) -> Column | None:
        return predicate(self.condition, df.columns) if self.condition else None

    def scoped(self, df: DataFrame) -> DataFrame:
        return df.where(self.scope(df)) if self.condition else df

    def in_scope(self, df: DataFrame, col: Column) -> Column:
        """The value where the condition holds, else null: for aggregates of the fused scan."""
        return F.when(self.scope(df), col) if self.condition else col

    # row rules
    def bad(self, df: DataFrame) -> Column:
        raise NotImplementedError

    def weight(self) -> int:
        """What each row adds to the total."""
        return 1

    # scalar and phased rules
    def metrics(self, df: DataFrame) -> dict[str, Column]:
        raise NotImplementedError

    def second(self, df: DataFrame, values: dict[str, Any]) -> dict[str, Column]:
        return {}

    def judge(self, values: dict[str, Any]) -> Outcome:
        raise NotImplementedError

    # plan and meta rules
    def run(self, df: DataFrame, ctx: Context) -> Outcome:
        raise NotImplementedError


def create(kind: str, params: dict[str, Any] | None = None, severity: str = "ERROR", condition: str | None = None) -> Rule:
    if kind not in REGISTRY:
        raise RuleError(f"no rule {kind!r}")
    return REGISTRY[kind](severity=severity, condition=condition, **(params or {}))


def count_true(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))
