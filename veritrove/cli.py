"""python -m veritrove.cli validate CONFIG | profile FILE | list-rules | coverage CONFIG | version"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .operators.base import REGISTRY
from .report import as_html, as_json, configuration, coverage, exit_code, run, suggest
from .spec import parse

VERSION = "0.1.0"


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="veritrove")
    sub = p.add_subparsers(dest="verb", required=True)
    v = sub.add_parser("validate")
    v.add_argument("config")
    v.add_argument("--json")
    v.add_argument("--html")
    f = sub.add_parser("profile")
    f.add_argument("file")
    f.add_argument("--format")
    f.add_argument("--sample", type=int)
    f.add_argument("--config", help="writes a job with the rules that the profile supports")
    c = sub.add_parser("coverage")
    c.add_argument("config")
    sub.add_parser("list-rules")
    sub.add_parser("version")
    a = p.parse_args(argv)
    if a.verb == "version":
        print(VERSION)
        return 0
    if a.verb == "list-rules":
        from .plans import planner  # noqa: F401  fills the registry

        for name, rule in sorted(REGISTRY.items()):
            print(f"{name}: {', '.join([*rule.REQUIRED, *(f'[{x}]' for x in rule.PARAMS)])}")
        return 0
    from pyspark.sql import SparkSession

    from .plans import planner  # noqa: F401

    if a.verb == "coverage":
        print(json.dumps(coverage(parse(Path(a.config).read_text())), indent=2))
        return 0
    spark = SparkSession.builder.appName("veritrove").getOrCreate()
    if a.verb == "profile":
        from .operators import profile
        from .operators.insights import column_summary
        from .sources.readers import load

        df = load(spark, a.file, a.format, max_rows=a.sample)
        numbers = [c for c in df.columns if profile.is_number(df, c)]
        parts = {"nulls": profile.null_kinds(df, df.columns), "types": profile.type_counts(df, df.columns), "top_values": profile.top_values(df, df.columns)}
        if numbers:
            parts["numeric"] = profile.numeric_profile(df, numbers)
        found = profile.privacy(df, df.columns)
        rules = suggest(column_summary(df, df.columns))
        if a.config:
            Path(a.config).write_text(configuration(Path(a.file).stem, a.file, rules))
        print(json.dumps({**{k: [r.asDict() for r in d.collect()] for k, d in parts.items()}, "suggestions": rules, "personal_data": found, "privacy_risk": profile.privacy_risk(found, len(df.columns))}, default=str, indent=2))
        return 0
    job = parse(Path(a.config).read_text())
    report = run(spark, job)
    for path, text in ((a.json, as_json(report)), (a.html, as_html(report))):
        if path:
            Path(path).write_text(text)
    print(report["status"])
    return exit_code(report, job.fail_on_warning)


if __name__ == "__main__":
    sys.exit(main())
