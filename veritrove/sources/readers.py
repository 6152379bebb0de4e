"""Readers: path -> normalised DataFrame (NaN is null, nested structs are flattened). Heads of files are read by Hadoop's API."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "jsonl", "parquet": "parquet", "xls": "excel", "xlsx": "excel", "orc": "orc"}
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
#: Holds the text of a row that does not parse.
BAD = "_corrupt_record"
CUSTOM: dict[str, Callable[..., DataFrame]] = {}


def register_loader(name: str, f: Callable[..., DataFrame]) -> None:
    """f(spark, path, **options) -> DataFrame, under a format name of its own."""
    CUSTOM[name] = f


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def file_status(spark: SparkSession, path: str) -> dict[str, int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return {"bytes": fs.getContentSummary(p).getLength(), "modified_ms": fs.getFileStatus(p).getModificationTime()}


def head_bytes(spark: SparkSession, path: str, most: int = 8192) -> bytes:
    """The first bytes of a file (of a folder or pattern: of its first file with content). No more than these is read."""
    fs, p = _fs(spark, path)
    files = [x for s in fs.globStatus(p) or [] for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s])]
    for status in sorted((x for x in files if x.isFile() and x.getLen() and not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().toString()):
        stream = fs.open(status.getPath())
        try:
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(most, status.getLen())))
        finally:
            stream.close()
    return b""


def sniff_delimiter(head: str) -> str:
    lines = [x for x in head.splitlines() if x][:20]
    best, sure = ",", 0
    for sep in (",", "\t", "|", ";", ":"):
        n = [x.count(sep) for x in lines]
        if n and min(n) > 0 and min(n) == max(n) and n[0] > sure:
            best, sure = sep, n[0]
    return best


def sniff_encoding(head: bytes) -> str:
    for e in ENCODINGS:
        try:
            head[: max(0, len(head) - 4)].decode(e)
            return "utf-8" if e == "utf-8-sig" else e
        except UnicodeDecodeError:
            continue
    return "latin-1"


def infer_format(path: str) -> str:
    ext = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ext not in EXTENSIONS:
        raise ValueError(f"no format for {path!r}")
    return EXTENSIONS[ext]


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns joined by _."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        df = df.select(*(c for f in df.schema for c in ([F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType] if isinstance(f.dataType, T.StructType) else [F.col(f"`{f.name}`")])))
    return df


def normalise(df: DataFrame) -> DataFrame:
    df = flatten(df)
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(*(F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns)) if floats else df


def load(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """options: delimiter, encoding, header, multi_line, sheet_name, schema, sample_percent, max_rows.

    Rows of CSV and JSON files that do not parse are left out; load_counted tells their number.
    """
    return load_counted(spark, path, form, **options)[0]


def _good(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows that parsed, and an observation whose `bad_rows` is known once the rows have been read by an action."""
    seen = Observation()
    df = df.observe(seen, F.count_if(F.col(f"`{BAD}`").isNotNull()).alias("bad_rows"))
    return df.where(F.col(f"`{BAD}`").isNull()).drop(BAD), seen


def load_counted(spark: SparkSession, path: str, form: str | None = None, **options) -> tuple[DataFrame, Observation | None]:
    """load(), and for CSV and JSON an observation with the number of rows left out as `bad_rows`.

    CSV files are split between tasks; multi_line (fields with line ends) makes each file one task's work.
    """
    form = form or infer_format(path)
    seen = None
    schema, percent, most = options.pop("schema", None), options.pop("sample_percent", None), options.pop("max_rows", None)
    read = spark.read.schema(schema) if schema else spark.read
    if form in CUSTOM:
        df = CUSTOM[form](spark, path, **options)
    elif form == "csv":
        head = head_bytes(spark, path) if not options.get("delimiter") or not options.get("encoding") else b""
        enc = options.get("encoding") or sniff_encoding(head)
        sep = options.get("delimiter") or sniff_delimiter(head.decode(enc, "replace"))
        how = {"sep": sep, "encoding": enc, "header": options.get("header", True), "multiLine": bool(options.get("multi_line", False)), "escape": '"'}
        known = T._parse_datatype_string(schema) if isinstance(schema, str) else schema or spark.read.csv(path, inferSchema=True, **how).schema
        df, seen = _good(spark.read.csv(path, schema=T.StructType([*known, T.StructField(BAD, T.StringType())]), mode="PERMISSIVE", columnNameOfCorruptRecord=BAD, **how))
    elif form in ("json", "jsonl"):
        array = form == "json" and head_bytes(spark, path, 64).lstrip()[:1] == b"["
        df = read.json(path, multiLine=array, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD)
        if BAD in df.columns:
            # Spark reads this column only beside others; files without any sound row have no other
            df, seen = _good(df) if len(df.columns) > 1 else (df.where(F.lit(False)).drop(BAD), None)
    elif form in ("parquet", "orc"):
        df = getattr(read, form)(path)
    elif form == "excel":
        import pandas as pd

        df = spark.createDataFrame(pd.read_excel(path, sheet_name=options.get("sheet_name", 0), header=options.get("header", 0)))
    else:
        raise ValueError(f"no format {form!r}")
    if percent is not None:
        df = df.sample(float(percent) / 100, seed=42)
    return normalise(df if most is None else df.limit(int(most))), seen


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.globStatus(p))


def resolve(spark: SparkSession, name: str, beside: str | None = None, base: str | None = None) -> str:
    """Absolute as it is; else the first that exists of: beside the data, under the base path, as given (also if none does)."""
    if name.startswith("/") or "://" in name:
        return name
    tries = ([f"{beside.rstrip('/').rsplit('/', 1)[0]}/{name}"] if beside and "/" in beside else []) + ([f"{base.rstrip('/')}/{name}"] if base else [])
    return next((t for t in tries if exists(spark, t)), name)
