"""Secret scans with a trigram inverted index.

A Boolean trigram query is derived from each rule's pattern: a necessary condition for a match, over the text with A-Z
lowered. Texts are indexed in segments (a few MB of text each): for every trigram that some query names, the segment's
postings list the rows that hold it. A rule's candidates are the rows left after intersecting and uniting postings; only
they are verified with the pattern. A rule whose query is empty (no mandatory trigram) is verified on every row.

Segments live and die inside one task, so there is no shuffle and memory is bounded by a segment. postings() gives the
same segments as a table, for storing.

Cases: null and empty texts have no spans; repeated rows and ids each give a row; an empty table gives no rows; only the
id and text columns are read, so other columns cannot clash. Texts are searched whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sc
from re import _parser as sre

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_bytes, pick, slabs

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@dataclass(frozen=True)
class Rule:
    """kind; pattern; least length of group `group` (0: the match); base kinds are the contract's, in its order."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return _compiled(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


@lru_cache(64)
def _compiled(pattern: str, flags: int) -> re.Pattern:
    return re.compile(pattern, flags)


# The three base rules of the contract.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further kinds of credentials, by the public shape of each.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE

#: A query is True (no condition), a trigram, or ("and" | "or", queries).
MOST_STRINGS = 64


def _strings(items, most: int = MOST_STRINGS) -> set[str] | None:
    """Every string that the parsed items can match, lowered; None if they are too many to list."""
    out = {""}
    for op, arg in items:
        if op is sc.LITERAL:
            one = {chr(arg).lower()}
        elif op is sc.IN and all(o is sc.LITERAL for o, _ in arg):
            one = {chr(a).lower() for _, a in arg}
        elif op is sc.SUBPATTERN:
            one = _strings(arg[-1], most)
        elif op is sc.BRANCH:
            parts = [_strings(x, most) for x in arg[1]]
            one = None if None in parts else set().union(*parts)
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[1] <= 3:
            inner = _strings(arg[2], most)
            one, power = (None if inner is None else set()), {""}
            for n in range(arg[1] + 1 if inner is not None else 0):
                if n >= arg[0]:
                    one |= power
                power = {a + b for a in power for b in inner}
        elif op is sc.AT:
            one = {""}
        else:
            one = None
        if one is None or len(out) * len(one) > most:
            return None
        out = {a + b for a in out for b in one}
    return out


def _all_of(strings: set[str]):
    """What holds if one of the strings occurs."""
    branches = []
    for s in sorted(strings):
        raw = s.encode().translate(LOWER)
        grams = sorted({raw[i : i + 3] for i in range(len(raw) - 2)})
        if not grams:
            return True
        branches.append(grams[0] if len(grams) == 1 else ("and", tuple(grams)))
    return branches[0] if len(branches) == 1 else ("or", tuple(branches))


def _join(kind: str, parts: list):
    if kind == "or" and any(p is True for p in parts):
        return True
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _derive(items) -> object:
    found, run = [], {""}

    def flush() -> None:
        found.append(_all_of(run))

    for item in items:
        op, arg = item
        one = _strings([item])
        if one is not None and len(run) * len(one) <= MOST_STRINGS:
            run = {a + b for a in run for b in one}
            continue
        flush()
        run = {""}
        if one is not None:
            run = one
        elif op is sc.SUBPATTERN:
            found.append(_derive(arg[-1]))
        elif op is sc.BRANCH:
            found.append(_join("or", [_derive(x) for x in arg[1]]))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT) and arg[0] > 0:
            found.append(_derive(arg[2]))
    flush()
    return _join("and", found)


@lru_cache(64)
def trigram_query(pattern: str) -> object:
    """The Boolean query over lowered trigrams that every text with a match of the pattern fulfils."""
    return _derive(list(sre.parse(pattern)))


def query_trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(query_trigrams, query[1]))


class Segment:
    """An inverted index of some texts, for the trigrams given: trigram -> sorted row numbers."""

    def __init__(self, column: pa.Array, grams: tuple[bytes, ...], wanted: np.ndarray):
        raw, starts = joined_bytes(column)
        self.rows = len(column)
        b = np.frombuffer(raw.translate(LOWER), dtype=np.uint8).astype(np.uint32)
        codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:] if len(b) > 2 else np.zeros(0, np.uint32)
        at = np.flatnonzero(wanted[codes])
        row = np.searchsorted(starts, at, "right") - 1
        inside = at + 3 <= starts[row + 1]
        codes, row = codes[at[inside]], row[inside]
        self.postings = {g: np.unique(row[codes == int.from_bytes(g, "big")]) for g in grams}

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.rows)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = [self.candidates(q) for q in query[1]]
        if query[0] == "or":
            return np.unique(np.concatenate(lists))
        out = lists[0]
        for more in sorted(lists[1:], key=len):
            out = np.intersect1d(out, more, assume_unique=True)
        return out


@lru_cache(8)
def _wanted(grams: tuple[bytes, ...]) -> np.ndarray:
    out = np.zeros(1 << 24, dtype=bool)
    out[[int.from_bytes(g, "big") for g in grams]] = True
    return out


def _grams(rules: tuple[Rule, ...]) -> tuple[bytes, ...]:
    return tuple(sorted(set().union(*(query_trigrams(trigram_query(r.pattern)) for r in rules))))


def _verified(text: str, rule: Rule) -> Iterator[tuple[int, int]]:
    for m in rule.compiled().finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def scan_texts(column: pa.Array, rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule number, end), sorted; code points, end exclusive."""
    grams = _grams(rules)
    segment = Segment(column, grams, _wanted(grams))
    texts: dict[int, str] = {}
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    for k, rule in enumerate(rules):
        for i in segment.candidates(trigram_query(rule.pattern)).tolist():
            if (text := texts.get(i)) is None:
                text = texts[i] = column[i].as_py() or ""
            found[i] += [(a, k, b) for a, b in _verified(text, rule)]
    for spans in found:
        spans.sort()
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each document: doc_id, text, spans array<struct<start, kind, end>>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_t = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            for part in slabs(batch):
                spans = [[{"start": a, "kind": rules[k].kind, "end": b} for a, k, b in x] for x in scan_texts(part.column("text"), rules)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind_t)], ["doc_id", "text", "spans"])

    rows = pick(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text string, spans array<struct<start:int,kind:string,end:int>>")


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The index as a table: a row for each segment and trigram, with the ids of the texts that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _grams(rules)
        for batch in batches:
            for part in slabs(batch):
                index = Segment(part.column("text"), grams, _wanted(grams))
                some = [g for g in grams if len(index.postings[g])]
                ids = [part.column("doc_id").take(pa.array(index.postings[g])).to_pylist() for g in some]
                yield pa.RecordBatch.from_arrays([pa.array([g.decode("latin-1") for g in some], pa.string()), pa.array(ids, pa.list_(part.schema.field("doc_id").type))], ["trigram", "doc_ids"])

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"trigram string, doc_ids array<{rows.schema['doc_id'].dataType.simpleString()}>")


def redact_columns(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text", mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns to keep, text with every span (overlaps united) replaced by the mark, n_secrets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, "__text"):
                texts, counts = [], []
                for i, spans in enumerate(scan_texts(part.column("__text"), rules)):
                    text = part.column("__text")[i].as_py()
                    if spans:
                        out, at = [], 0
                        for a, _, b in spans:
                            if a >= at:
                                out += [text[at:a], mark]
                            at = max(at, b)
                        text = "".join([*out, text[at:]])
                    texts.append(text)
                    counts.append(len(spans))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string()), pa.array(counts, pa.int32())], [*part.schema.names[1:], "text", "n_secrets"])

    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *keep)
    kind = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[1:])
    return rows.mapInArrow(run, f"{kind}text string, n_secrets int")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of the contract, from the spans that scan_texts() finds."""
    order = {r.kind: i for i, r in enumerate(RULES)}
    found = scan(docs, id_col, text_col).drop("text")
    said = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"].isin(*(r.kind for r in BASE)))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    assert list(order)[:3] == [r.kind for r in BASE]
    return found.select(
        "doc_id",
        *(count(r.kind).alias(f"n_{r.kind}") for r in BASE),
        F.sha2(F.array_join(F.transform(base, said), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", said), ",").alias("spans"),
    )


def brute_force(text: str | None) -> tuple[list[tuple[int, str, int]], str]:
    """The base spans and their digest, without an index; for tests."""
    spans = sorted((a, k, b) for k, r in enumerate(BASE) for a, b in _verified(text or "", r))
    said = ",".join(f"{BASE[k].kind}:{a}:{b}" for a, k, b in spans)
    return [(a, BASE[k].kind, b) for a, k, b in spans], hashlib.sha256(said.encode()).hexdigest()
