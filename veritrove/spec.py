"""Jobs from YAML, with limits on size, depth and keys; unknown rules and parameters are errors at load time."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml

from .operators.base import Rule, RuleError, create

MOST_BYTES, MOST_DEPTH, MOST_KEYS = 10 << 20, 20, 10_000


@dataclass(frozen=True)
class FileSpec:
    name: str
    path: str
    format: str | None
    options: dict[str, Any]
    rules: list[Rule]


@dataclass(frozen=True)
class JobSpec:
    name: str
    files: list[FileSpec]
    fail_on_warning: bool = False
    critical: dict[str, list[str]] = field(default_factory=dict)


def _measure(x: Any, depth: int = 0) -> int:
    if depth > MOST_DEPTH:
        raise RuleError("configuration is nested too deeply")
    inner = list(x.values()) if isinstance(x, dict) else x if isinstance(x, list) else []
    return (len(x) if isinstance(x, dict) else 0) + sum(_measure(v, depth + 1) for v in inner)


def parse(text: str) -> JobSpec:
    if len(text.encode()) > MOST_BYTES:
        raise RuleError("configuration is too large")
    raw = yaml.safe_load(text)
    if not isinstance(raw, dict) or _measure(raw) > MOST_KEYS:
        raise RuleError("not a configuration, or too many keys")
    job = raw.get("job", raw)
    files = []
    for f in job.get("files", []):
        rules = [create(v["type"], v.get("params"), v.get("severity", "ERROR"), v.get("condition")) for v in f.get("validations", [])]
        files.append(FileSpec(f.get("name") or f["path"], f["path"], f.get("format"), f.get("options", {}), rules))
    if not files:
        raise RuleError("no files")
    return JobSpec(job.get("name", "job"), files, bool(job.get("fail_on_warning")), {c["file"]: c["fields"] for c in job.get("critical_data", [])})
