"""Jobs from YAML to reports, coverage, the command line and streams."""

import pytest

from veritrove import cli
from veritrove.operators.base import RuleError, create
from veritrove.report import as_html, as_json, coverage, exit_code, output_path, run, suggest
from veritrove.spec import parse
from veritrove.streaming.adapter import read_results, validate_stream

CONFIG = """
job:
  name: nightly
  files:
    - name: orders
      path: {path}
      validations:
        - type: RangeCheck
          params: {{field: o_totalprice, min_value: 0}}
        - type: ValidValuesCheck
          severity: WARNING
          params: {{field: o_orderstatus, valid_values: [F, O]}}
        - type: UniqueKeyCheck
          params: {{fields: [o_orderkey]}}
  critical_data:
    - {{file: orders, fields: [o_orderkey, o_custkey]}}
"""


@pytest.fixture(scope="module")
def job(sf_dir):
    return parse(CONFIG.format(path=f"{sf_dir}/orders.parquet"))


def test_run(spark, job):
    events = []
    report = run(spark, job, observers=(lambda e, _: events.append(e),))
    assert report["status"] == "WARNING" and exit_code(report) == 0 and exit_code(report, True) == 2
    assert len(report["files"][0]["results"][1]["samples"]) == 10
    assert "nightly" in as_html(report) and '"rule": "RangeCheck"' in as_json(report)
    assert events == ["job_start", "file_start", "file_end", "job_end"]


def test_missing_file(spark):
    report = run(spark, parse(CONFIG.format(path="/no/such.parquet")))
    assert report["status"] == "FAILED" and report["files"][0]["results"][0]["rule"] == "FileProcessing"


def test_coverage_and_suggestions(job):
    assert [(c["field"], c["covered"]) for c in coverage(job)] == [("o_orderkey", True), ("o_custkey", False)]
    kinds = [s["type"] for s in suggest({"a": {"total": 100, "nulls": 0, "distinct": 100, "low": 1, "high": 9}, "b": {"total": 100, "nulls": 1, "values": ["x", "y"]}})]
    assert kinds == ["MandatoryFieldCheck", "UniqueKeyCheck", "RangeCheck", "ValidValuesCheck"]


@pytest.mark.parametrize("text", ["[]", "job: {files: []}", "job: {files: [{path: a, validations: [{type: Nope}]}]}"])
def test_bad_configurations(text):
    with pytest.raises(RuleError):
        parse(text)


def test_command_line(capsys):
    assert cli.main(["version"]) == 0 and cli.main(["list-rules"]) == 0
    assert "RangeCheck" in capsys.readouterr().out


def test_output_path():
    assert output_path("{job_name}/{file_name}.json", "a b", "c/d") == "a_b/c_d.json"


def test_stream(spark, sf_dir, tmp_path):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    orders.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(orders.schema).parquet(str(tmp_path / "in"))
    q = validate_stream(stream, [create("ValidValuesCheck", {"field": "o_orderstatus", "valid_values": ["F"]})], str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert read_results(spark, str(tmp_path / "out")).agg({"total_count": "sum"}).first()[0] == orders.count()
    with pytest.raises(RuleError):
        validate_stream(stream, [create("UniqueKeyCheck", {"fields": ["o_orderkey"]})], "x", "y")
