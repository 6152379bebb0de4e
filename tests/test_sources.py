"""Heads, bad rows and paths of files; rules that cannot be bound beside sound ones; exact quantiles."""

import random
import statistics

from pyspark.sql import functions as F

from veritrove.operators.base import Context, create
from veritrove.operators.profile import PLACEHOLDERS, privacy
from veritrove.operators.quantiles import exact_quantiles
from veritrove.plans.planner import outcomes
from veritrove.sources.readers import head_bytes, load, load_counted, resolve


def test_head_is_bounded(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x;y\n" + "1;2\n" * 100_000)
    assert head_bytes(spark, str(f), 10) == b"x;y\n1;2\n1;"
    assert head_bytes(spark, str(tmp_path), 3) == b"x;y"
    (tmp_path / "b").write_text("")
    assert head_bytes(spark, str(tmp_path / "b")) == b""


def test_bad_csv_rows_are_counted(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("x,y\n1,2\n3,4,5,6\n7,8\n")
    df, seen = load_counted(spark, str(f))
    assert sorted(map(tuple, df.collect())) == [(1, 2), (7, 8)] and seen.get["bad_rows"] == 1


def test_bad_json_rows_are_counted(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"x": 1}\n{"x": \n{"x": 3}\n')
    df, seen = load_counted(spark, str(f))
    assert sorted(r["x"] for r in df.collect()) == [1, 3] and seen.get["bad_rows"] == 1


def test_line_ends_within_fields(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('x,y\n1,"two\nlines"\n')
    assert load(spark, str(f), multi_line=True).first()["y"] == "two\nlines"


def test_resolve_looks_whether_a_file_exists(spark, tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "base" / "r.csv").write_text("a\n1\n")
    beside, base = str(tmp_path / "data.csv"), str(tmp_path / "base")
    assert resolve(spark, "r.csv", beside, base) == f"{base}/r.csv"
    (tmp_path / "r.csv").write_text("a\n1\n")
    assert resolve(spark, "r.csv", beside, base) == f"{tmp_path}/r.csv"
    assert resolve(spark, "none.csv", beside, base) == "none.csv"


def test_bad_rules_leave_others_alone(spark):
    df = spark.createDataFrame([(1,), (5,)], "x int")
    rules = [create("RangeCheck", {"field": "x", "max_value": 3}), create("RangeCheck", {"field": "x", "max_value": 3}, condition="zzz > 1"), create("InlineBusinessRuleCheck", {"rule": "zz > 1"}), create("RangeCheck", {"field": "gone", "max_value": 1})]
    found = outcomes(df, rules, Context(spark))
    assert (found[0].failed, found[0].total) == (1, 2)
    assert all(not o.passed and o.message for o in found[1:])


def test_exact_quantiles_against_the_library(spark):
    rng = random.Random(3)
    groups = {k: [rng.choice([0.0, 1.0, rng.gauss(0, 9)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 501), (None, 40))}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("d", None)]
    df = spark.createDataFrame(rows, "key string, x double")
    got = {r["key"]: r for r in exact_quantiles(df, (0.25, 0.5, 0.75)).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        want = statistics.quantiles(v, n=4, method="inclusive") if len(v) > 1 else v * 3
        assert (got[k]["n"], got[k]["distinct"]) == (len(v), len(set(v)))
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k]["q"], want, strict=True))


def test_quantiles_of_several_slots(spark, monkeypatch):
    from veritrove.operators import quantiles as Q

    monkeypatch.setattr(Q, "SLOT", 50)
    df = spark.range(1000).select(F.lit("a").alias("key"), F.pmod(F.col("id") * 7, F.lit(613)).cast("double").alias("x"))
    values = sorted(float(i * 7 % 613) for i in range(1000))
    assert Q.exact_quantiles(df, (0.1, 0.5, 0.9)).first()["q"] == [statistics.quantiles(values, n=10, method="inclusive")[k] for k in (0, 4, 8)]


def test_quantiles_rank_only_values_near_the_levels(spark):
    from veritrove.operators import quantiles as Q

    n = 200_000
    df = spark.range(n).select(F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("key"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("x"))
    assert Q.ranked(df, (0.25, 0.5, 0.99)).count() < n / 100
    rows = df.groupBy("key").agg(F.sort_array(F.collect_list("x")).alias("v")).collect()
    got = {r["key"]: r for r in Q.exact_quantiles(df, (0.0, 0.25, 0.5, 0.99, 1.0)).collect()}
    for r in rows:
        v = r["v"]
        ranks = [p * (len(v) - 1) for p in (0.0, 0.25, 0.5, 0.99, 1.0)]
        assert got[r["key"]]["distinct"] == len(set(v))
        assert got[r["key"]]["q"] == [v[int(k)] if int(k) == k else v[int(k)] + (k - int(k)) * (v[int(k) + 1] - v[int(k)]) for k in ranks]


def test_a_poor_sketch_makes_no_quantile_wrong(spark, monkeypatch):
    from veritrove.operators import quantiles as Q

    monkeypatch.setattr(Q, "SLOT", 10)
    monkeypatch.setattr(Q, "NEAR", 0.0)
    df = spark.createDataFrame([("a", float(min(900, max(300, i)))) for i in range(1000)], "key string, x double")
    assert Q.exact_quantiles(df, (0.0, 0.1, 0.5, 0.95, 1.0)).first()["q"] == [300.0, 300.0, 499.5, 900.0, 900.0]


def test_slots_are_found_by_halving(spark):
    from bisect import bisect_left

    from veritrove.operators.stat_rules import below

    for n in (1, 2, 7, 8, 600):
        edges = [float(3 * i) for i in range(n)]
        rows = spark.createDataFrame([(float(x),) for x in range(-2, 3 * n + 2)], "x double").select("x", below(edges, F.col("x")).alias("k")).collect()
        assert all(r["k"] == bisect_left(edges, r["x"]) for r in rows)


def test_cards_need_the_check_digit(spark):
    good, bad = "4111 1111 1111 1111", "4111 1111 1111 1112"
    kinds = lambda texts: {f["kind"] for f in privacy(spark.createDataFrame([(t,) for t in texts], "x string"), ["x"])}
    assert "credit_card" in kinds([good] * 9 + [bad]) and "credit_card" not in kinds([bad] * 9 + [good])


def test_placeholders_are_lower_case():
    assert all(p == p.lower() for p in PLACEHOLDERS)


def test_a_profile_makes_a_job_that_its_table_passes(spark, sf_dir):
    from veritrove.operators.insights import column_summary
    from veritrove.report import configuration, run, suggest
    from veritrove.spec import parse

    path = f"{sf_dir}/nation.parquet"
    df = spark.read.parquet(path)
    text = configuration("nation", path, suggest(column_summary(df, df.columns)))
    report = run(spark, parse(text))
    assert {r["rule"] for r in report["files"][0]["results"]} >= {"MandatoryFieldCheck", "UniqueKeyCheck"}
    assert report["status"] == "PASSED"


def test_outlier_methods_of_empty_and_constant_columns(spark):
    from veritrove.operators.insights import agreement, length_anomalies, outlier_methods

    none = spark.createDataFrame([], "x double")
    assert tuple(outlier_methods(none, "x").first()) == (0, 0, 0, 0, 0)
    assert tuple(outlier_methods(spark.createDataFrame([(2.0,)] * 5, "x double"), "x").first()) == (0, 0, 0, 0, 0)
    assert length_anomalies(spark.createDataFrame([("a",), (None,)], "x string"), "x").count() == 0
    assert agreement({"zscore": 1, "iqr": 1, "modified": 1}, 100) == "high" and agreement({"zscore": 0, "iqr": 9, "modified": 3}, 100) == "low"
