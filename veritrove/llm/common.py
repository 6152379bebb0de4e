"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text are worked on in slabs of about so many bytes, so that memory does not follow the batch size.
SLAB_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="veritrove-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Ends the lineage with a Parquet table in the shared folder; for wide rows, of which later steps read some columns."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def pick(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id and text (null: empty) under fixed names, and no other column unless asked for."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), *more)


def sample_below(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most about `most` rows, those with the smallest hash of the id. Only hashes are ranked, never the rows."""
    h = F.xxhash64(F.col(id_col))
    edge = rows.select(h.alias("h")).orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return rows.where(h <= F.lit(edge)) if edge is not None else rows.limit(0)


def slabs(batch: pa.RecordBatch, text_col: str = "text", most: int = SLAB_BYTES):
    """Slices of a batch with about `most` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(text_col)).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def joined_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts of a column in one byte string, and where each begins (with the end)."""
    texts = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data is not None and len(texts) else b""
    return raw, offsets - offsets[0]
