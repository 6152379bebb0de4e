"""Packing documents into sequences of fixed size: cutting stock by column generation.

Documents are cut at every CAP ids; what is left over is a piece. A piece's class is its length, rounded up to a multiple
of GRID, and the histogram over classes (CAP / GRID of them at most, whatever the corpus) is all that the driver gets. On
it a linear program chooses how often each pattern (a multiset of classes that fits in a sequence) is used; a knapsack
dynamic program over the classes' dual values prices new patterns until none improves the bound. Pattern counts are
rounded down, and what demand remains is packed first-fit decreasing, class by class. Then the k-th piece of a class, in
the order of a hash bucket and the id within it, gets the k-th place of that class among all patterns: ranks come from counts
by class and bucket, so no class, however common, is ranked in a single task.

A sequence is padded to CAP unless its length is a power of two.

Cases: null and empty texts hold the end id alone; repeated ids are separate documents only if their texts differ in
the columns given, else identical rows are ranked in any order, which changes no result but between themselves; an empty
table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pick, slabs
from .tokens import END_ID, encode_with_end, vocabulary_path

CAP = 4096
GRID = 8
#: The linear program stops here at the latest, or once it is so near its bound.
MOST_ROUNDS = 4000
GAP = 5e-4
#: Pieces to a bucket of ranks, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 256, 4096


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, row (a tie-break), and the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch):
                of, start, length, crc, total, row, lists = [], [], [], [], [], [], []
                for i, ids in enumerate(encode_with_end(part.column("text").to_pylist(), vocabulary, end_id)):
                    raw = ids.astype("<u4").tobytes()
                    for a in range(0, len(ids), cap):
                        b = min(a + cap, len(ids))
                        of.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(raw[4 * a : 4 * b]))
                        total.append(len(ids))
                        row.append(zlib.crc32(raw))
                        if with_ids:
                            lists.append(ids[a:b].astype(np.int32))
                cols = [part.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, row))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"]
                if with_ids:
                    cols, names = [*cols, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = pick(docs, id_col, text_col)
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, row long"
    return rows.mapInArrow(run, kind + ", ids array<int>" * with_ids)


@dataclass(frozen=True)
class Plan:
    """Patterns as (classes, counts of each class), how often each is used, and the first sequence of each."""

    patterns: list[dict[int, int]]
    times: list[int]


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of sizes (ascending) within the room: unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c], k = best[c - 1], upto[c]
        if k:
            gains = values[:k] + best[c - sizes[:k]]
            j = int(gains.argmax())
            if gains[j] > best[c] + 1e-12:
                best[c], taken[c] = gains[j], j
    out: dict[int, int] = {}
    c = room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[int(taken[c])] = out.get(int(taken[c]), 0) + 1
            c -= int(sizes[taken[c]])
    return float(best[room]), out


def linear_program(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[dict[int, int]], np.ndarray]:
    """Basic patterns and how often the relaxation uses each: revised simplex with generated columns."""
    m = len(sizes)
    patterns = [{j: int(room // sizes[j])} for j in range(m)]
    inverse = np.diag(1.0 / (room // sizes))
    used = inverse @ demand
    for _ in range(MOST_ROUNDS):
        duals = inverse.sum(0)
        value, pattern = best_pattern(np.maximum(duals, 0), sizes, room)
        if value <= 1 + GAP:
            break
        column = np.zeros(m)
        for j, n in pattern.items():
            column[j] = n
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = used[up] / step[up]
        leave = int(ratio.argmin())
        pivot = inverse[leave] / step[leave]
        used = np.maximum(used - ratio[leave] * step, 0)
        used[leave] = ratio[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        patterns[leave] = pattern
    return patterns, used


def first_fit(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[dict[int, int]], list[int]]:
    """Packs what is left, the largest first, each bin filled with the largest that fits; equal bins are merged."""
    left = demand.copy()
    found: dict[tuple, int] = {}
    while left.any():
        space, bin_ = room, {}
        for j in range(len(sizes) - 1, -1, -1):
            if left[j] and sizes[j] <= space:
                n = int(min(left[j], space // sizes[j]))
                bin_[j] = n
                space -= n * int(sizes[j])
        times = min(int(left[j]) // n for j, n in bin_.items())
        for j, n in bin_.items():
            left[j] -= n * times
        key = tuple(sorted(bin_.items()))
        found[key] = found.get(key, 0) + times
    return [dict(k) for k in found], list(found.values())


def plan(histogram: dict[int, int], room: int) -> Plan:
    """Patterns over classes (1..room) that hold every class as often as the histogram has it, exactly."""
    classes = np.array(sorted(histogram), dtype=np.int64)
    if not len(classes):
        return Plan([], [])
    left = np.array([histogram[c] for c in classes.tolist()], dtype=np.int64)
    patterns, used = linear_program(classes, left.astype(float), room)
    out, times = [], []
    for p, x in zip(patterns, np.floor(used + 1e-9).astype(np.int64).tolist(), strict=True):
        x = min([x, *(int(left[j]) // n for j, n in p.items())])
        if x > 0:
            for j, n in p.items():
                left[j] -= n * x
            out.append(p)
            times.append(x)
    more, often = first_fit(classes, left, room)
    patterns = [{int(classes[j]): n for j, n in p.items()} for p in [*out, *more]]
    return Plan(patterns, [*times, *often])


def places(found: Plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class its runs of ranks: first rank, pieces of the class in a sequence, first sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    seen: dict[int, int] = {}
    base = 0
    for p, x in zip(found.patterns, found.times, strict=True):
        for c, n in p.items():
            runs.setdefault(c, []).append((seen.get(c, 0), n, base))
            seen[c] = seen.get(c, 0) + n * x
        base += x
    return {c: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for c, r in runs.items()}


def assign(rows: DataFrame, cap: int = CAP, grid: int = GRID) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, row, ...), which should be cheap to read twice."""
    rows = rows.withColumn("class", F.ceil(F.col("length") / grid).cast("int"))
    histogram = {r["class"]: r["n"] for r in rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = places(plan(histogram, cap // grid))
    buckets = int(min(MOST_BUCKETS, max(1, sum(histogram.values()) // BUCKET_ROWS)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(buckets)).cast("int"))
    order = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "row")
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")).select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(order) - 1).join(counts, ["class", "bucket"]).withColumn("rank", F.col("before") + F.col("nth")).drop("nth", "before", "bucket")
    sent = rows.sparkSession.sparkContext.broadcast(runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            seq = np.zeros(len(kind), dtype=np.int64)
            for c in np.unique(kind).tolist():
                first, n, base = sent.value[c]
                own = np.flatnonzero(kind == c)
                k = np.searchsorted(first, rank[own], "right") - 1
                seq[own] = base[k] + (rank[own] - first[k]) // n[k]
            yield batch.append_column("sequence_id", pa.array(seq))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    placed = ranked.mapInArrow(run, f"{kind}, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("class", "rank")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece, with the sequence and offset it gets (and its ids if asked for)."""
    return assign(cut(pieces(docs, vocabulary, id_col, text_col, with_ids=with_ids)))


def padding(length: int, cap: int = CAP) -> int:
    return 0 if length & (length - 1) == 0 else cap - length


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs, vocabulary_path()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
