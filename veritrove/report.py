"""Running jobs, and their reports as JSON or HTML."""

from __future__ import annotations

import datetime as dt
import html
import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from .operators.base import Context
from .plans.planner import outcomes, samples
from .sources.readers import load
from .spec import JobSpec

Observer = Callable[[str, dict[str, Any]], None]


def run(spark: SparkSession, job: JobSpec, now: str | None = None, observers: tuple[Observer, ...] = (), most_samples: int = 10) -> dict[str, Any]:
    """A report: files, each with its rules' results; ERROR failures outrank WARNING ones."""

    def tell(event: str, **what: Any) -> None:
        for o in observers:
            o(event, what)

    tell("job_start", job=job.name)
    files = []
    for f in job.files:
        tell("file_start", file=f.name)
        try:
            df = load(spark, f.path, f.format, **f.options)
            found = list(zip(f.rules, outcomes(df, f.rules, Context(spark, f.name, f.path, format=f.format, now=now)), strict=True))
            rows = []
            for r, o in found:
                bad = [x.asDict() for x in samples(df, r, most_samples).collect()] if r.kind == "row" and o.failed else []
                rows.append({"rule": r.name, "severity": r.severity, "passed": o.passed, "failed_count": o.failed, "total_count": o.total, "message": o.message, "details": o.details, "samples": bad})
        except Exception as e:  # a file that cannot be read fails its own report, not the job
            rows = [{"rule": "FileProcessing", "severity": "ERROR", "passed": False, "failed_count": 1, "total_count": 1, "message": str(e)[:500], "details": {}, "samples": []}]
        files.append({"file": f.name, "path": f.path, "status": status(rows), "results": rows})
        tell("file_end", file=f.name, status=files[-1]["status"])
    out = {"job": job.name, "status": status([r for f in files for r in f["results"]]), "files": files}
    tell("job_end", **out)
    return out


def status(rows: list[dict[str, Any]]) -> str:
    failed = {r["severity"] for r in rows if not r["passed"]}
    return "FAILED" if "ERROR" in failed else "WARNING" if failed else "PASSED"


def exit_code(report: dict[str, Any], fail_on_warning: bool = False) -> int:
    return 1 if report["status"] == "FAILED" else 2 if report["status"] == "WARNING" and fail_on_warning else 0


def as_json(report: dict[str, Any]) -> str:
    return json.dumps(report, default=str, indent=2)


def as_html(report: dict[str, Any]) -> str:
    e = lambda x: html.escape(str(x))
    body = []
    for f in report["files"]:
        rows = "".join(f"<tr class={'ok' if r['passed'] else 'bad'}><td>{e(r['rule'])}<td>{e(r['severity'])}<td>{r['failed_count']}<td>{r['total_count']}<td>{e(r['message'])}" for r in f["results"])
        body.append(f"<h2>{e(f['file'])}: {f['status']}</h2><table><tr><th>rule<th>severity<th>failed<th>total<th>message{rows}</table>")
    return f"<!doctype html><meta charset=utf-8><title>{e(report['job'])}</title><style>td,th{{padding:2px 8px}}.bad{{background:#fdd}}</style><h1>{e(report['job'])}: {report['status']}</h1>{''.join(body)}"


def output_path(pattern: str, job: str, file: str = "", table: str = "", now: dt.datetime | None = None) -> str:
    """A path with {date} {time} {timestamp} {datetime} {job_name} {file_name} {table_name} filled in."""
    now = now or dt.datetime.now()
    safe = lambda x: "".join(c if c.isalnum() or c in "-_." else "_" for c in x)
    return pattern.format(date=f"{now:%Y-%m-%d}", time=f"{now:%H%M%S}", timestamp=f"{now:%Y%m%d_%H%M%S}", datetime=f"{now:%Y-%m-%dT%H%M%S}", job_name=safe(job), file_name=safe(file), table_name=safe(table))


def coverage(job: JobSpec) -> list[dict[str, Any]]:
    """For each critical field whether a rule of its file looks at it."""
    out = []
    for f in job.files:
        seen: dict[str, set[str]] = {}
        for r in f.rules:
            for c in r.columns():
                seen.setdefault(c, set()).add(r.name)
        out += [{"file": f.name, "field": c, "covered": c in seen, "rules": sorted(seen.get(c, ()))} for c in job.critical.get(f.name, [])]
    return out


def configuration(name: str, path: str, suggestions: list[dict[str, Any]]) -> str:
    """The YAML of a job that checks one file by the rules suggested; spec.parse() reads it."""
    import yaml

    plain = lambda x: x if isinstance(x, (str, int, float, bool, type(None))) else [plain(v) for v in x] if isinstance(x, (list, tuple)) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else float(x)
    return yaml.safe_dump({"job": {"name": name, "files": [{"name": name, "path": path, "validations": [{"type": s["type"], "severity": "WARNING", "params": plain(s["params"])} for s in suggestions]}]}}, sort_keys=False, allow_unicode=True)


def suggest(counts: dict[str, dict[str, Any]]) -> list[dict[str, Any]]:
    """Rules that a profile supports; counts: column -> total, nulls, distinct, low, high, values (if few)."""
    out = []
    for c, p in counts.items():
        if p["total"] and not p["nulls"]:
            out.append({"type": "MandatoryFieldCheck", "params": {"fields": [c]}})
        if p["total"] > 1 and p.get("distinct") == p["total"] - p["nulls"] and p["total"] > p["nulls"]:
            out.append({"type": "UniqueKeyCheck", "params": {"fields": [c]}})
        if p.get("values") and len(p["values"]) <= 20 and p["total"] >= 5 * len(p["values"]):
            out.append({"type": "ValidValuesCheck", "params": {"field": c, "valid_values": sorted(p["values"])}})
        elif p.get("low") is not None and p.get("high") is not None:
            out.append({"type": "RangeCheck", "params": {"field": c, "min_value": p["low"], "max_value": p["high"]}})
    return out
