"""Token-ID output in a binary format: patched frame-of-reference (PFOR) blocks with an index.

Layout of a segment (little-endian): magic, counts, then the document index (ids and token counts), the index of block
starts, and the blocks. A block holds BLOCK ids: its minimum is subtracted and the rest packed at the width, in bits, that
covers EXCEPT_SHARE of the block; ids that need more bits are patched from the block's exception list (position, high
part). The index of block starts lets a reader decode any range without reading the rest.

Documents are range-partitioned by id, sorted, encoded and packed; a partition's number is the number of its range. Segments of at most SEGMENT ids or so are written through Spark's Parquet committer as binary
values with their range and number, so that lost tasks are retried and any store that Spark writes will do; starts are
running totals over segments. Reading back takes the files alone.

Cases: null and empty texts hold the end id alone; a null doc_id counts as the smallest; repeated ids lie side by side
in an order by text; an empty table writes no segment and reads back no rows. A document longer than SEGMENT fills a
segment of its own. Only the id and text columns are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, shared_dir, slabs
from .tokens import END_ID, encode_with_end, vocabulary_path

BLOCK = 128
SEGMENT = 1 << 20
EXCEPT_SHARE = 0.95
MAGIC = b"PFR1"
#: Documents to a range of ids.
RANGE_DOCS = 8192
NULL_ID = -(1 << 63)


def _pack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values of `width` bits -> rows of bytes."""
    bits = ((rows[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(bits.reshape(len(rows), -1), axis=1, bitorder="little")


def _unpack_bits(raw: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : BLOCK * width].reshape(len(raw), BLOCK, width)
    out = np.zeros((len(raw), BLOCK), dtype=np.uint32)
    for k in range(width):
        out |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
    return out


def pack_blocks(ids: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Starts of the blocks in the payload (with its end), and the payload. The last block is filled with its last id."""
    n = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.repeat(ids[-1:], n * BLOCK - len(ids))]).astype(np.uint32).reshape(n, BLOCK)
    low = full.min(1)
    rest = full - low[:, None]
    need = np.frexp(rest.astype(np.float64))[1].astype(np.uint8)  # bits of each value
    cover = int(np.ceil(EXCEPT_SHARE * BLOCK)) - 1
    width = np.partition(need, cover, axis=1)[:, cover].astype(np.uint32)
    patched = need > width[:, None]
    counts = patched.sum(1).astype(np.uint16)
    head = np.zeros(n, dtype=[("low", "<u4"), ("width", "u1"), ("n", "<u2")])
    head["low"], head["width"], head["n"] = low, width, counts
    sizes = head.itemsize + (BLOCK // 8) * width.astype(np.int64) + 5 * counts
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(starts[-1]), dtype=np.uint8)
    out[starts[:-1, None] + np.arange(head.itemsize)] = head.view(np.uint8).reshape(n, -1)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        size = BLOCK * w // 8
        out[(starts[at] + head.itemsize)[:, None] + np.arange(size)] = _pack_bits(rest[at] & np.uint32((1 << w) - 1), w)
    block, place = np.nonzero(patched)
    extra = np.zeros(len(block), dtype=[("at", "u1"), ("high", "<u4")])
    extra["at"], extra["high"] = place, rest[block, place] >> width[block]
    nth = np.arange(len(block)) - np.repeat(np.cumsum(counts, dtype=np.int64) - counts, counts)
    where = starts[block] + head.itemsize + (BLOCK // 8) * width[block].astype(np.int64) + 5 * nth
    out[where[:, None] + np.arange(5)] = extra.view(np.uint8).reshape(-1, 5)
    return starts, out.tobytes()


def unpack_blocks(starts: np.ndarray, payload: np.ndarray) -> np.ndarray:
    """All ids of the blocks whose starts (with an end) are given; payload as bytes."""
    n, size = len(starts) - 1, 7
    head = payload[starts[:-1, None] + np.arange(size)].copy().view([("low", "<u4"), ("width", "u1"), ("n", "<u2")]).reshape(n)
    width, counts = head["width"].astype(np.uint32), head["n"].astype(np.int64)
    out = np.zeros((n, BLOCK), dtype=np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        out[at] = _unpack_bits(payload[(starts[at] + size)[:, None] + np.arange(BLOCK * w // 8)], w)
    block = np.repeat(np.arange(n), counts)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(counts) - counts, counts)
    where = starts[block] + size + (BLOCK // 8) * width[block].astype(np.int64) + 5 * nth
    extra = payload[where[:, None] + np.arange(5)].copy().view([("at", "u1"), ("high", "<u4")]).reshape(-1)
    out[block, extra["at"]] |= extra["high"] << width[block]
    return (out + head["low"][:, None]).reshape(-1)


def write_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    starts, payload = pack_blocks(ids)
    return b"".join([MAGIC, struct.pack("<III", len(doc_ids), len(ids), len(starts)), doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), payload])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their token counts, and all ids."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, tokens, blocks = struct.unpack_from("<III", raw, 4)
    at = 16
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    counts = np.frombuffer(raw, "<u4", docs, at := at + 8 * docs)
    starts = np.frombuffer(raw, "<u4", blocks, at := at + 4 * docs).astype(np.int64)
    payload = np.frombuffer(raw, np.uint8, offset=at + 4 * blocks)
    return doc_ids, counts, unpack_blocks(starts, payload)[:tokens]


def read_range(raw: bytes, first: int, last: int) -> np.ndarray:
    """Ids first..last-1 of a segment, from the blocks that hold them alone."""
    docs, tokens, blocks = struct.unpack_from("<III", raw, 4)
    if not 0 <= first <= last <= tokens:
        raise IndexError("outside of the segment")
    if first == last:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-last // BLOCK)
    starts = np.frombuffer(raw, "<u4", b - a + 1, 16 + 12 * docs + 4 * a).astype(np.int64)
    payload = np.frombuffer(raw, np.uint8, offset=16 + 12 * docs + 4 * blocks)
    return unpack_blocks(starts, payload)[first - a * BLOCK : last - a * BLOCK]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, per_range: int = RANGE_DOCS) -> None:
    """Encodes the texts and writes segments (range, number, n_docs, n_tokens, data) to `path`."""
    rows = pick(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(max(1, -(-rows.count() // per_range)), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[int, np.ndarray]] = []
        now, number, held = TaskContext.get().partitionId(), 0, 0

        def flush() -> pa.RecordBatch:
            data = write_segment(np.array([d for d, _ in own]), np.array([len(x) for _, x in own]), np.concatenate([x for _, x in own]))
            cols = [pa.array([now], pa.int32()), pa.array([number], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["range", "number", "n_docs", "n_tokens", "data"])

        for batch in batches:
            for part in slabs(batch):
                encoded = encode_with_end(part.column("text").to_pylist(), vocabulary, end_id)
                for d, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    if own and held + len(ids) > SEGMENT:
                        yield flush()
                        own, held, number = [], 0, number + 1
                    own.append((d, ids))
                    held += len(ids)
        if own:
            yield flush()

    rows.mapInArrow(run, "range int, number int, n_docs long, n_tokens long, data binary").write.parquet(path)


def segment_starts(segments: DataFrame) -> DataFrame:
    """(range, number, start): ids before each segment. Totals by range, then by group of ranges, then within each."""
    totals = segments.groupBy("range").agg(F.sum("n_tokens").alias("n")).withColumn("g", F.col("range").bitwiseAND(F.lit(~1023)))
    groups = totals.groupBy("g").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("g", F.coalesce(F.sum("n").over(before("g")), F.lit(0)).alias("of_g"))
    ranges = totals.select("g", "range", F.coalesce(F.sum("n").over(before("g", "range")), F.lit(0)).alias("of_r")).join(groups, "g")
    own = segments.select("range", "number", F.coalesce(F.sum("n_tokens").over(before("range", "number")), F.lit(0)).alias("of_s"))
    return own.join(ranges, "range").select("range", "number", (F.col("of_g") + F.col("of_r") + F.col("of_s")).alias("start"))


def read_tokens(spark, path: str, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start, n_tokens, ids_crc32 of each document, and its ids if asked for."""
    kind = "range int, number int, n_docs long, n_tokens long, data binary"
    files = spark.read.schema(kind).parquet(path)
    starts = segment_starts(files.select("range", "number", "n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, base in zip(batch.column("data"), batch.column("start").to_pylist(), strict=True):
                doc_ids, counts, ids = read_segment(raw.as_py())
                ends = np.cumsum(counts, dtype=np.int64)
                wide, at = memoryview(ids.astype("<u4").tobytes()), [0, *(4 * ends).tolist()]
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at, at[1:])]  # noqa: B905
                cols = [pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(ends - counts + base), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return files.join(starts, ["range", "number"]).select("data", "start").mapInArrow(run, out)


def digest(docs: DataFrame) -> DataFrame:
    """The contract: writes the files and reads them back."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, vocabulary_path())
    return read_tokens(spark, path)
