"""Compares queries with their SQL in DuckDB, as multisets of rows with columns sorted by name."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def _rows(names, rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs."""
    got = con.execute(sql)
    names, want = [d[0] for d in got.description], _rows([d[0] for d in got.description], got.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if have == want:
        return ""
    only, lack = [r for r in have if r not in want][:3], [r for r in want if r not in have][:3]
    return f"{len(have)} and {len(want)} rows; only Spark: {only}; only SQL: {lack}"
