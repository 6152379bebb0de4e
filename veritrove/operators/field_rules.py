"""Row rules: field, record and expression checks. Nulls never violate unless a rule says so."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import COMPARE, datetime_pattern, java_regex, number, predicate, string
from .base import Context, Outcome, Rule, RuleError, count_true, create


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


class MandatoryFieldCheck(Rule):
    """Null, or blank text unless white space is allowed; each field of each row counts."""

    REQUIRED = ("fields",)
    PARAMS = {"allow_whitespace": False}
    kind = "scalar"

    def columns(self):
        return list(self.p["fields"])

    def _bad(self, df: DataFrame, c: str) -> Column:
        blank = F.trim(string(c)) == "" if isinstance(df.schema[c].dataType, T.StringType) and not self.p["allow_whitespace"] else F.lit(False)
        return _c(c).isNull() | F.coalesce(blank, F.lit(False))

    def bad(self, df):
        return reduce(or_, (self._bad(df, c) for c in self.p["fields"]))

    def metrics(self, df):
        out = {f"f{i}": count_true(self.in_scope(df, self._bad(df, c))) for i, c in enumerate(self.p["fields"])}
        return out | {"n": F.count(self.in_scope(df, F.lit(1)))}

    def judge(self, v):
        failed = sum(v[f"f{i}"] for i in range(len(self.p["fields"])))
        return Outcome(failed, v["n"] * len(self.p["fields"]), failed == 0)


class RegexCheck(Rule):
    """The text matches from its start (or, inverted, does not)."""

    REQUIRED = ("field", "pattern")
    PARAMS = {"message": None, "invert": False}

    def bad(self, df):
        hit = string(self.p["field"]).rlike(java_regex(self.p["pattern"], anchored=True))
        return hit if self.p["invert"] else ~hit


class InlineRegexCheck(Rule):
    """The pattern is found anywhere (or, with should_match false, nowhere)."""

    REQUIRED = ("field", "pattern")
    PARAMS = {"should_match": True, "description": None}

    def bad(self, df):
        hit = string(self.p["field"]).rlike(java_regex(self.p["pattern"]))
        return ~hit if self.p["should_match"] else hit


class FormatCheck(Rule):
    """The whole text has the format."""

    REQUIRED = ("field", "pattern")

    def bad(self, df):
        return ~string(self.p["field"]).rlike(f"^(?:{java_regex(self.p['pattern'])})$")


class ValidValuesCheck(Rule):
    REQUIRED = ("field", "valid_values")
    PARAMS = {"case_sensitive": True}

    def bad(self, df):
        x, values = string(self.p["field"]), [str(v) for v in self.p["valid_values"]]
        if not self.p["case_sensitive"]:
            x, values = F.lower(x), [v.lower() for v in values]
        return ~x.isin(*values)


class InlineLookupCheck(Rule):
    REQUIRED = ("field", "reference_values")
    PARAMS = {"check_type": "allow", "description": None}

    def check(self):
        if self.p["check_type"] not in ("allow", "deny"):
            raise RuleError("check_type is allow or deny")

    def bad(self, df):
        hit = string(self.p["field"]).isin(*(str(v) for v in self.p["reference_values"]))
        return ~hit if self.p["check_type"] == "allow" else hit


class BooleanCheck(Rule):
    REQUIRED = ("field",)
    PARAMS = {"true_values": ("true", "1", "yes", "y", "t"), "false_values": ("false", "0", "no", "n", "f")}

    def bad(self, df):
        return ~F.lower(string(self.p["field"])).isin(*(str(v).lower() for v in (*self.p["true_values"], *self.p["false_values"])))


class RangeCheck(Rule):
    """Inclusive bounds; what is not a number is skipped."""

    REQUIRED = ("field",)
    PARAMS = {"min_value": None, "max_value": None}

    def check(self):
        if self.p["min_value"] is None and self.p["max_value"] is None:
            raise RuleError("RangeCheck needs a bound")

    def bad(self, df):
        x, out = number(self.p["field"]), []
        if self.p["min_value"] is not None:
            out.append(x < float(self.p["min_value"]))
        if self.p["max_value"] is not None:
            out.append(x > float(self.p["max_value"]))
        return reduce(or_, out)


class DateFormatCheck(Rule):
    """Text that does not parse by the strptime format; nulls too unless allowed."""

    REQUIRED = ("field", "format")
    PARAMS = {"allow_null": True}

    def bad(self, df):
        x = string(self.p["field"])
        wrong = x.isNotNull() & F.try_to_timestamp(x, F.lit(datetime_pattern(self.p["format"]))).isNull()
        return wrong if self.p["allow_null"] else wrong | x.isNull()


class BlankRecordCheck(Rule):
    PARAMS = {"exclude_fields": ()}

    def bad(self, df):
        names = [c for c in df.columns if c not in self.p["exclude_fields"]]
        return reduce(and_, (F.coalesce(F.trim(string(c)) == "", F.lit(True)) for c in names), F.lit(bool(names)))


class InlineBusinessRuleCheck(Rule):
    """A predicate that every row must fulfil; a comparison with a null does not hold."""

    REQUIRED = ("rule",)
    PARAMS = {"description": None, "error_message": None}

    def bad(self, df):
        return ~predicate(self.p["rule"], df.columns)


class CrossFieldComparisonCheck(Rule):
    REQUIRED = ("field_a", "operator", "field_b")

    def check(self):
        if self.p["operator"] not in COMPARE:
            raise RuleError(f"operator {self.p['operator']!r}")

    def bad(self, df):
        a, b = _c(self.p["field_a"]), _c(self.p["field_b"])
        return a.isNotNull() & b.isNotNull() & ~COMPARE[self.p["operator"]](a, b)


class StringLengthCheck(Rule):
    REQUIRED = ("field",)
    PARAMS = {"min_length": None, "max_length": None}

    def check(self):
        if self.p["min_length"] is None and self.p["max_length"] is None:
            raise RuleError("StringLengthCheck needs a bound")

    def bad(self, df):
        n, out = F.length(string(self.p["field"])), []
        if self.p["min_length"] is not None:
            out.append(n < int(self.p["min_length"]))
        if self.p["max_length"] is not None:
            out.append(n > int(self.p["max_length"]))
        return reduce(or_, out)


class NumericPrecisionCheck(Rule):
    """Decimal places of the number without trailing zeros; exact takes precedence over max."""

    REQUIRED = ("field",)
    PARAMS = {"max_decimal_places": None, "exact_decimal_places": None}

    def check(self):
        if self.p["max_decimal_places"] is None and self.p["exact_decimal_places"] is None:
            raise RuleError("NumericPrecisionCheck needs a number of places")

    def bad(self, df):
        text = string(self.p["field"]).try_cast("decimal(38,18)").cast("string")
        places = F.length(F.rtrim(F.regexp_extract(text, r"\.(\d+)", 1), F.lit("0")))
        exact = self.p["exact_decimal_places"]
        return places != int(exact) if exact is not None else places > int(self.p["max_decimal_places"])


class BusinessDayCheck(Rule):
    """Dates on Saturdays and Sundays violate."""

    REQUIRED = ("field",)

    def bad(self, df):
        return F.weekday(_c(self.p["field"]).cast("timestamp")) >= 5


class CompletenessCheck(Rule):
    """Non-null share against a minimum (over 1: per cent). No rows: share 0."""

    kind = "scalar"
    REQUIRED = ("field", "min_completeness")

    def metrics(self, df):
        return {"n": F.count(self.in_scope(df, F.lit(1))), "full": F.count(self.in_scope(df, _c(self.p["field"])))}

    def judge(self, v):
        least = float(self.p["min_completeness"])
        share = v["full"] / v["n"] if v["n"] else 0.0
        return Outcome(v["n"] - v["full"], v["n"], share >= (least / 100 if least > 1 else least), details={"completeness": share})


class RecencyCheck(Rule):
    """The newest date is at most max_days_old days before the clock."""

    kind = "scalar"
    REQUIRED = ("field",)
    PARAMS = {"max_days_old": 90, "now": None}

    def metrics(self, df):
        now = F.to_timestamp(F.lit(str(self.p["now"]))) if self.p["now"] else F.current_timestamp()
        return {"n": F.count(self.in_scope(df, F.lit(1))), "age": F.datediff(now, F.max(self.in_scope(df, _c(self.p["field"]).cast("timestamp"))))}

    def judge(self, v):
        old = v["age"] is None or v["age"] > int(self.p["max_days_old"])
        return Outcome(int(old), 1, not old, details={"age_days": v["age"]})


class RowCountRangeCheck(Rule):
    kind = "scalar"
    PARAMS = {"min_rows": None, "max_rows": None}

    def metrics(self, df):
        return {"n": F.count(self.in_scope(df, F.lit(1)))}

    def judge(self, v):
        low, high = self.p["min_rows"], self.p["max_rows"]
        wrong = (low is not None and v["n"] < low) or (high is not None and v["n"] > high)
        return Outcome(int(wrong), 1, not wrong, details={"rows": v["n"]})


class ConditionalValidation(Rule):
    """Nested rules for the rows that fulfil a condition, others for the rest; failures add up."""

    kind = "plan"
    REQUIRED = ("condition_expr",)
    PARAMS = {"then_validate": (), "else_validate": ()}

    def __init__(self, severity="ERROR", condition=None, **params):
        params.setdefault("condition_expr", condition)
        super().__init__(severity, None, **params)

    def check(self):
        build = lambda xs: [create(x["type"], x.get("params"), x.get("severity", self.severity)) for x in xs]
        self.nested = {True: build(self.p["then_validate"]), False: build(self.p["else_validate"])}

    def bind(self, df):
        predicate(self.p["condition_expr"], df.columns)
        for rules in self.nested.values():
            for r in rules:
                r.bind(df)

    def run(self, df: DataFrame, ctx: Context) -> Outcome:
        from ..plans.planner import outcomes

        holds = predicate(self.p["condition_expr"], df.columns)
        found = [o for side, rules in self.nested.items() if rules for o in outcomes(df.where(holds if side else ~holds), rules, ctx)]
        failed = sum(o.failed for o in found)
        return Outcome(failed, sum(o.total for o in found), all(o.passed for o in found))
