"""SimHash near-duplicates: 64-bit fingerprints linked at few differing bits through a Gray-order hierarchical index.

1. Fingerprints: words of the lower-cased text, 4-word shingles with repeats, XXH64; a bit is the majority's.
2. Distinct fingerprints are dealt by block keys: words that differ in at most LIMIT bits agree on one choice of blocks at
   least (pigeonhole). The number of blocks follows the count of fingerprints, so that buckets keep a bounded mean size.
3. A bucket of over MOST entries is cut into parts; each pair of parts is a task's work of its own, so no task gets an
   unbounded bucket and no pair is lost.
4. Each bucket is searched with the index of gray_index.py; a spanning forest of its links goes on.
5. Components of the links, joined back to all documents. Exact copies share a fingerprint and are never paired.

Cases: null and empty texts have fingerprint zero, which links like any other; texts of under 4 words are one shingle;
repeated rows and ids each give a row; a null doc_id never names a component unless all ids in it are null; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pick, slabs
from .components import components
from .gray_index import close_pairs, forest, gray_rank

LIMIT = 4
SHINGLE = 4
#: Entries of a bucket that one task searches at most (twice as many for two parts).
MOST = 16_384
#: Mean bucket size, as a power of two, beyond which keys take one block more.
MEAN_BITS = 8
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.cumsum([0, *(len(w) + 1 for w in words)])
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        digest = xxhash.xxh64_intdigest
        at = starts.tolist()
        hashes = [digest(joined[a : b - 1], 42) for a, b in zip(at, at[SHINGLE:])]  # noqa: B905
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch):
                fps = np.array([fingerprint(t) for t in part.column("text").to_pylist()], dtype="<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(n: int, limit: int = LIMIT, bits: int = 64, mean_bits: int = MEAN_BITS) -> list[int]:
    """Masks of which two words that differ in at most `limit` bits agree on one at least.

    With limit + m blocks, m are free of differences. m is the least for which n words over the masks' bits make
    buckets of at most 2^mean_bits words on average.
    """
    m = 1
    while bits * m / (limit + m) < math.log2(max(2, n)) - mean_bits and m < 6:
        m += 1
    blocks = limit + m
    edges = [round(bits * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, m)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _bucket_links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (b, key, part); links of each bucket as a forest. A bucket may go on in the next batch."""
    names = ("b", "key", "part", "fp")
    kept: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
        b, key, part, fp = cols
        new = np.r_[True, (b[1:] != b[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1])]
        bucket = np.cumsum(new)
        words = fp.view(np.uint64)
        order = np.lexsort((gray_rank(words), bucket))
        bucket, words = bucket[order], words[order]
        root = forest(len(words), close_pairs(bucket, words, limit))
        at = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(words[at].view(np.int64)), pa.array(words[root[at]].view(np.int64))], ["a", "b"])

    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if kept is not None:
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
        if not len(cols[0]):
            continue
        last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
        to = last[-1] + 1 if len(last) else 0
        if to:
            yield solve([c[:to] for c in cols])
        kept = [c[to:] for c in cols]
    if kept is not None and len(kept[0]):
        yield solve(kept)


def links(fps: DataFrame, limit: int = LIMIT, most: int = MOST) -> DataFrame:
    """(a, b): links that connect every two distinct fingerprints (column fp) of at most `limit` differing bits."""
    masks = block_masks(fps.count(), limit)
    keyed = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(masks)))).alias("x")).select("x.b", "x.key", "fp")
    sizes = keyed.groupBy("b", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        keyed.join(sizes, ["b", "key"])
        .select("b", "key", "fp", parts.alias("parts"))
        .select("b", "key", "fp", "parts", own.alias("own"))
        .select("b", "key", "fp", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least("own", j) * 32768 + F.greatest("own", j))).alias("part"))
    )
    dealt = dealt.repartition("b", "key", "part").sortWithinPartitions("b", "key", "part")
    return dealt.mapInArrow(lambda batches: _bucket_links(batches, limit), "a long, b long")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (smallest doc_id that it can reach)."""
    rows = cut(fingerprints(docs, id_col, text_col))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(classes.select("fp"), limit)).withColumnRenamed("node", "fp")
    named = classes.join(joined, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("fp", "component_id")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def digest(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
