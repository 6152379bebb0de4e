"""Rules on small frames: nulls, empty tables, errors, conditions, and that fusing changes nothing."""

import numpy as np
import pytest

from veritrove.functions.exprs import ExpressionError, datetime_pattern, java_regex, predicate
from veritrove.functions.tails import chi2_tail, correlation_tail, kolmogorov_tail, normal_cdf
from veritrove.operators import stat_rules
from veritrove.operators.base import Context, RuleError, create
from veritrove.plans.planner import outcomes, samples
from veritrove.sources.jdbc import QueryError, guarded_query, guarded_url, identifier
from veritrove.sources.readers import load, sniff_delimiter


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(1, "a@x.io", 5.0, None), (2, None, None, "x"), (3, "  ", float("nan"), "y"), (3, "bad", 9.5, "y")], "id int, mail string, v double, c string")


def one(df, spark, kind, params, condition=None):
    return outcomes(df, [create(kind, params, condition=condition)], Context(spark, tables={"ref": df.where("id < 3")}, now="2024-01-31"))[0]


@pytest.mark.parametrize(
    ("kind", "params", "failed", "total"),
    [
        ("MandatoryFieldCheck", {"fields": ["mail", "c"]}, 3, 8),
        ("MandatoryFieldCheck", {"fields": ["mail"], "allow_whitespace": True}, 1, 4),
        ("RegexCheck", {"field": "mail", "pattern": "[a-z]"}, 1, 4),
        ("RangeCheck", {"field": "v", "max_value": 6}, 1, 4),
        ("ValidValuesCheck", {"field": "id", "valid_values": [1, 2]}, 2, 4),
        ("UniqueKeyCheck", {"fields": ["c"]}, 1, 4),
        ("DuplicateRowCheck", {"key_fields": ["id", "c"]}, 1, 4),
        ("ReferentialIntegrityCheck", {"foreign_key": "id", "reference_file": "ref", "reference_key": "id"}, 2, 4),
        ("ReferentialIntegrityCheck", {"foreign_key": "c", "reference_file": "ref", "reference_key": "c"}, 3, 4),
        ("CompletenessCheck", {"field": "c", "min_completeness": 0.75}, 1, 4),
        ("NumericPrecisionCheck", {"field": "v", "max_decimal_places": 0}, 1, 4),
        ("InlineBusinessRuleCheck", {"rule": "v > 5"}, 3, 4),
    ],
)
def test_counts(spark, frame, kind, params, failed, total):
    got = one(frame.replace(float("nan"), None), spark, kind, params)
    assert (got.failed, got.total) == (failed, total)


def test_condition_and_samples(spark, frame):
    assert one(frame, spark, "RangeCheck", {"field": "v", "max_value": 6}, "id == 3").total == 2
    assert samples(frame, create("ValidValuesCheck", {"field": "id", "valid_values": [1, 2]})).count() == 2


def test_empty_table(spark, frame):
    kinds = [("MandatoryFieldCheck", {"fields": ["mail"]}), ("RangeCheck", {"field": "v", "max_value": 6}), ("StatisticalOutlierCheck", {"field": "v", "method": "iqr"}), ("UniqueKeyCheck", {"fields": ["id"]}), ("AdvancedAnomalyDetectionCheck", {"column": "v", "method": "modified_zscore"})]
    assert [o.failed for o in outcomes(frame.limit(0), [create(*k) for k in kinds], Context(spark))] == [0] * 5


def test_errors(spark, frame):
    with pytest.raises(RuleError):
        create("RangeCheck", {"field": "v"})
    with pytest.raises(RuleError):
        create("NoSuchCheck")
    got = outcomes(frame, [create("RangeCheck", {"field": "gone", "max_value": 1}), create("RangeCheck", {"field": "id", "max_value": 2})], Context(spark))
    assert not got[0].passed and "gone" in got[0].message and got[1].failed == 2


def test_fusing_changes_nothing(spark, frame):
    rules = [create("RangeCheck", {"field": "id", "max_value": 2}), create("RegexCheck", {"field": "mail", "pattern": "a"}), create("StatisticalOutlierCheck", {"field": "id", "threshold": 1})]
    ctx = Context(spark)
    assert outcomes(frame, rules, ctx) == [outcomes(frame.repartition(3), [r], ctx)[0] for r in rules]


@pytest.mark.parametrize(("text", "n"), [("id > 1 and not c == 'y'", 1), ("~(id == 1) | v >= 5", 4), ("c.isnull()", 1), ("id in (1, 2) and v != 7", 2), ("v / (id - 1) > 2", 1), ("`id` + 1 == 4", 2)])
def test_predicates(frame, text, n):
    assert frame.replace(float("nan"), None).where(predicate(text, frame.columns)).count() == n


@pytest.mark.parametrize("text", ["", "id >", "gone == 1", "id ; 1", "id == 1 )", "id in 3"])
def test_bad_predicates(frame, text):
    with pytest.raises(ExpressionError):
        predicate(text, frame.columns)


def test_translations():
    assert datetime_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    assert java_regex("(?P<a>x)(?P=a)") == r"(?<a>x)\k<a>"


def test_tails():
    assert abs(normal_cdf(1.96) - 0.9750021) < 1e-6
    assert abs(chi2_tail(15.507, 8) - 0.05) < 1e-4
    assert abs(correlation_tail(0.5, 20) - 0.0248) < 1e-3
    assert abs(kolmogorov_tail(0.1, 100) - 0.257) < 0.02


def test_guards():
    assert guarded_query("SELECT 'drop; --' FROM t;") == "SELECT 'drop; --' FROM t"
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "WITH a AS (SELECT 1) DELETE FROM t"):
        with pytest.raises(QueryError):
            guarded_query(bad)
    with pytest.raises(QueryError):
        identifier("a b")
    with pytest.raises(QueryError):
        guarded_url("file:///etc/passwd")


def test_formats_agree(spark, frame, tmp_path):
    df = frame.select("id", "c").dropna()
    df.coalesce(1).write.csv(str(tmp_path / "a.csv"), header=True, sep="|")
    df.write.parquet(str(tmp_path / "a.parquet"))
    df.write.json(str(tmp_path / "a.jsonl"))
    want = sorted(map(tuple, df.collect()))
    for name in ("a.csv", "a.parquet", "a.jsonl"):
        assert sorted((r["id"], r["c"]) for r in load(spark, str(tmp_path / name)).collect()) == want
    assert sniff_delimiter("a;b\n1;2\n") == ";"


@pytest.mark.parametrize(("n", "values", "slot"), [(6000, 5, 4096), (3000, 40, 64), (3000, 10**9, 100), (2, 10, 4096)])
def test_kendall_is_of_all_rows(spark, monkeypatch, n, values, slot):
    monkeypatch.setattr(stat_rules, "SLOT", slot, raising=False)
    rng = np.random.default_rng(n + values)
    a = rng.integers(0, values, n)
    b = np.where(rng.random(n) < 0.3, a, rng.integers(0, values, n)) - values / 2
    s, t = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    want = (s * t).sum() / np.sqrt(float((s != 0).sum()) * float((t != 0).sum()))
    df = spark.createDataFrame(list(zip(range(n), a.tolist(), b.tolist(), strict=True)), "id long, a long, b double")
    if n > 2:
        rule = {"column1": "a", "column2": "b", "correlation_type": "kendall", "expected_correlation": float(want), "tolerance": 1e-6}
        assert one(df, spark, "CorrelationCheck", rule).passed
    assert abs(stat_rules.kendall(df.select(df.a.cast("double").alias("a"), "b")) - want) < 1e-9


def test_kendall_of_one_value(spark):
    assert stat_rules.kendall(spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")) is None
    assert stat_rules.kendall(spark.createDataFrame([], "a double, b double")) is None
