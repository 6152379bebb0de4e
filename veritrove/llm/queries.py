"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann_search, byte_bpe, language_id, line_dedup, packing, secret_scan, simhash_dedup, token_files, toxicity, winnowing
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_secret_scan": _over("documents", secret_scan.digest),
    "op2_winnowing": _over("documents", winnowing.digest),
    "op3_byte_bpe": _over("documents", byte_bpe.digest),
    "op4_line_dedup": _over("documents", line_dedup.digest),
    "op5_token_files": _over("documents", token_files.digest),
    "op6_ann_search": _over("embeddings", ann_search.search),
    "op7_packing": _over("documents", packing.digest),
    "op8_toxicity": lambda spark, sf_dir: toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op9_simhash_dedup": _over("documents", simhash_dedup.digest),
    "op10_language_id": _over("documents", language_id.digest),
}

#: DuckDB SQL for those queries that it can express.
ORACLES: dict[str, str] = {}
