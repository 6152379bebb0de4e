"""Database sources over JDBC, and what may be sent to them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROTOCOLS = ("jdbc:sqlite:", "jdbc:postgresql:", "jdbc:mysql:", "jdbc:sqlserver:", "jdbc:oracle:", "jdbc:h2:", "jdbc:derby:")
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]{0,62}(\.[A-Za-z_][A-Za-z0-9_$]{0,62}){0,2}")
DENIED = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|revoke|merge|call|exec|execute|attach)\b", re.I)
STRINGS = re.compile(r"'(?:[^']|'')*'")


class QueryError(ValueError):
    """A query, name or address that is not allowed."""


def identifier(name: str) -> str:
    if not IDENTIFIER.fullmatch(name) or DENIED.fullmatch(name):
        raise QueryError(f"not an identifier: {name!r}")
    return name


def guarded_query(query: str) -> str:
    """A single SELECT (or WITH), without comments or statements that change data, outside of its string literals."""
    bare = STRINGS.sub("''", query).strip().rstrip(";")
    if not re.match(r"(select|with)\b", bare, re.I) or ";" in bare or "--" in bare or "/*" in bare or DENIED.search(bare):
        raise QueryError("one SELECT only")
    return query.strip().rstrip(";")


def guarded_url(url: str) -> str:
    if not url.lower().startswith(PROTOCOLS) or ".." in url:
        raise QueryError("address not allowed")
    return url


def read_query(spark: SparkSession, url: str, query: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.format("jdbc").option("url", guarded_url(url)).option("query", guarded_query(query)).load()
    return df if max_rows is None else df.limit(max_rows)


def read_table(spark: SparkSession, url: str, table: str, max_rows: int | None = None, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 1) -> DataFrame:
    """A whole table, in parallel ranges of a numeric column if one is given."""
    r = spark.read.format("jdbc").option("url", guarded_url(url)).option("dbtable", identifier(table))
    if partition_column and bounds:
        r = r.option("partitionColumn", identifier(partition_column)).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    df = r.load()
    return df if max_rows is None else df.limit(max_rows)
