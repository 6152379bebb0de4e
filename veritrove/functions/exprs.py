"""The predicate language of rules and conditions, compiled to Columns by a Pratt parser; nothing is ever evaluated as code.

Comparisons (== != < <= > >=, in, not in, .isnull(), .notnull()), arithmetic, and/or/not in words or signs (& | ~), back-quoted
names, numbers, strings, true/false/null. Logic is two-valued: a comparison with a null is false (!= is true). NOT has
SQL's precedence. A name that the data lack, or a malformed text, is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|`(?P<quoted>[^`]+)`
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>==|!=|<>|<=|>=|[-+*/%<>=&|~(),.\[\]]))""",
    re.VERBOSE,
)
COMPARE = {
    "==": lambda a, b: F.coalesce(a == b, F.lit(False)),
    "!=": lambda a, b: F.coalesce(a != b, F.lit(True)),
    "<": lambda a, b: F.coalesce(a < b, F.lit(False)),
    "<=": lambda a, b: F.coalesce(a <= b, F.lit(False)),
    ">": lambda a, b: F.coalesce(a > b, F.lit(False)),
    ">=": lambda a, b: F.coalesce(a >= b, F.lit(False)),
}
ALIASES = {"&": "and", "|": "or", "~": "not", "=": "==", "<>": "!="}


class ExpressionError(ValueError):
    """A predicate that cannot be parsed or bound."""


class _Parser:
    def __init__(self, text: str, columns: list[str]):
        self.columns, self.tokens, at = columns, [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ExpressionError(f"unexpected text at {at}: {text[at : at + 20]!r}")
            kind, value = m.lastgroup, m.group(m.lastgroup)
            if kind == "name" and value.lower() in ("and", "or", "not", "in", "true", "false", "null", "none"):
                kind, value = "sign", value.lower()
            self.tokens.append((kind, ALIASES.get(value, value) if kind == "sign" else value))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str | None, str | None]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *signs: str) -> str | None:
        kind, value = self.peek()
        if kind == "sign" and value in signs:
            self.at += 1
            return value
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise ExpressionError(f"expected {sign!r}, found {self.peek()[1]!r}")

    def whole(self) -> Column:
        out = self.disjunction()
        if self.at < len(self.tokens):
            raise ExpressionError(f"unexpected {self.peek()[1]!r}")
        return out

    def disjunction(self) -> Column:
        out = self.conjunction()
        while self.take("or"):
            out = out | self.conjunction()
        return out

    def conjunction(self) -> Column:
        out = self.negation()
        while self.take("and"):
            out = out & self.negation()
        return out

    def negation(self) -> Column:
        return ~self.negation() if self.take("not") else self.comparison()

    def comparison(self) -> Column:
        left = self.sum()
        out = None
        while True:
            if sign := self.take(*COMPARE):
                right = self.sum()
                one, left = COMPARE[sign](left, right), right
            elif self.take("in"):
                one = F.coalesce(left.isin(*self.listed()), F.lit(False))
            elif self.peek() == ("sign", "not") and self.tokens[self.at + 1 : self.at + 2] == [("sign", "in")]:
                self.at += 2
                one = ~F.coalesce(left.isin(*self.listed()), F.lit(False))
            else:
                return left if out is None else out
            out = one if out is None else out & one

    def listed(self) -> list[Column]:
        close = ")" if self.take("(") else "]" if self.take("[") else None
        if close is None:
            raise ExpressionError("in needs a list")
        out = [self.sum()]
        while self.take(","):
            out.append(self.sum())
        self.need(close)
        return out

    def sum(self) -> Column:
        out = self.product()
        while sign := self.take("+", "-"):
            out = out + self.product() if sign == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.atom()
        while sign := self.take("*", "/", "%"):
            right = self.atom()
            out = out * right if sign == "*" else F.try_divide(out, right) if sign == "/" else out % F.nullif(right, F.lit(0))
        return out

    def atom(self) -> Column:
        if self.take("-"):
            return -self.atom()
        if self.take("("):
            out = self.disjunction()
            self.need(")")
            return self.tail(out)
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return F.lit(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "string":
            return F.lit(re.sub(r"\\(.)", r"\1", value[1:-1]))
        if kind == "sign" and value in ("true", "false"):
            return F.lit(value == "true")
        if kind == "sign" and value in ("null", "none"):
            return F.lit(None)
        if kind in ("name", "quoted"):
            if value not in self.columns:
                raise ExpressionError(f"no column {value!r}")
            return self.tail(F.col(f"`{value}`"))
        raise ExpressionError(f"unexpected {value!r}" if value else "unexpected end")

    def tail(self, out: Column) -> Column:
        while self.take("."):
            _, method = self.peek()
            self.at += 1
            self.need("(")
            self.need(")")
            if method not in ("isnull", "notnull", "isna", "notna"):
                raise ExpressionError(f"no method {method!r}")
            out = out.isNull() if method in ("isnull", "isna") else out.isNotNull()
        return out


def predicate(text: str, columns: list[str]) -> Column:
    """A never-null boolean Column for a predicate over the given columns."""
    if not text or not text.strip():
        raise ExpressionError("empty predicate")
    return F.coalesce(_Parser(text, columns).whole().cast("boolean"), F.lit(False))


# Directives of strptime and the letters of Spark's datetime patterns.
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "E", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "z", "%": "%"}


def datetime_pattern(form: str) -> str:
    """A strptime format as a Spark datetime pattern; text between directives is quoted."""
    out, at = [], 0
    while at < len(form):
        if form[at] == "%" and at + 1 < len(form):
            if form[at + 1] not in DIRECTIVES:
                raise ValueError(f"unknown directive %{form[at + 1]}")
            out.append(DIRECTIVES[form[at + 1]])
            at += 2
        else:
            out.append(f"'{form[at]}'" if form[at].isalpha() else "''" if form[at] == "'" else form[at])
            at += 1
    return "".join(out)


def java_regex(pattern: str, anchored: bool = False) -> str:
    """A Python regular expression for rlike: named groups translated, anchored at the start if asked for."""
    out = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    out = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", out)
    return f"^(?:{out})" if anchored else out


def number(col: str) -> Column:
    """The column as a double; what is not a number, and NaN, is null."""
    x = F.col(f"`{col}`").try_cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def string(col: str) -> Column:
    return F.col(f"`{col}`").cast("string")
