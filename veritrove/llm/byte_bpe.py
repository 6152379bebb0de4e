"""Byte-level BPE encoding and decoding with Spark's higher-order functions.

A text is split by the tokenizer's pattern. A piece's bytes (as Latin-1 characters) are folded: every step ranks all
adjacent pairs in a literal rank map and merges the leftmost pair of the lowest rank, until no pair has a rank. The rank
map is an array of small maps, found by a hash of the pair, because a map of Spark is searched from end to end.

Distinct words are folded once where that pays: the words of a sample are counted, and the ids of the CACHED most frequent
are folded beforehand and passed as a second literal of bounded size. All other words are folded where they occur, so the
choice of the sample changes the time and no result. Pieces of over LONG bytes, on which a fold would take quadratic time,
are merged with a heap in an Arrow function, which gets those pieces and nothing else.

Decoding looks the ids' byte pieces up in a literal array and concatenates them.

Cases: null and empty texts have no ids and decode to the empty text; repeated rows are encoded each; an empty table gives no
rows. Only the id and text columns are read. Ids are the ranks; special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import json
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, sample_below

RANKS = "byte_bpe_50k.tiktoken"
BUCKETS = 1 << 14
CACHED, CACHED_BYTES = 131_072, 48
SAMPLE_DOCS = 16_000
LONG = 256
NO_RANK = 1 << 30


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pattern(of: str | None = None) -> str:
    """The splitting pattern, with Unicode white space, as the tokenizers' regex has it."""
    if of is None:
        import public_tokenizers

        of = public_tokenizers.PATTERN
    return f"(?U){of}"


def vocabulary_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _bucketed(entries: dict[str, object], kind: str) -> Column:
    """A literal array of BUCKETS small maps, by the low bits of Spark's xxhash64 of the key."""
    maps: list[dict] = [{} for _ in range(BUCKETS)]
    for key, value in entries.items():
        maps[xxhash.xxh64_intdigest(key.encode(), 42) % BUCKETS][key] = value
    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False, separators=(",", ":"))), f"array<map<string,{kind}>>")


def _found(buckets: Column, key: Column) -> Column:
    return F.element_at(F.element_at(buckets, (F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)) + 1).cast("int")), key)


def _latin(text: Column) -> Column:
    return F.decode(text.cast("binary"), "ISO-8859-1")


def _let(value: Column, body) -> Column:
    """body(value), with the value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(piece: Column, ranks: Column) -> Column:
    """The ids of a piece, joined by blanks: ranked merges folded over its bytes.

    The state is the parts and the ranks of their adjacent pairs; a merge looks two new pairs up.
    """
    rank = lambda x: F.coalesce(_found(ranks, x), F.lit(NO_RANK))
    none = F.array().cast("array<int>")
    first = F.split(_latin(piece), "")
    last = F.length(_latin(piece)) - 1
    pairs = F.zip_with(F.slice(first, 1, last), F.slice(first, 2, last), lambda a, b: rank(F.concat(a, b)))
    start = F.struct(first.alias("parts"), pairs.alias("ranks"))

    def merge(state: Column, i: Column) -> Column:
        parts, known = state["parts"], state["ranks"]
        whole = F.concat(F.get(parts, i - 1), F.get(parts, i))
        left = F.when(i > 1, F.array(rank(F.concat(F.get(parts, i - 2), whole)))).otherwise(none)
        right = F.when(i < F.size(known), F.array(rank(F.concat(whole, F.get(parts, i + 1))))).otherwise(none)
        return F.struct(
            F.concat(F.slice(parts, 1, i - 1), F.array(whole), F.slice(parts, i + 2, F.size(parts))).alias("parts"),
            F.concat(F.slice(known, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(known, i + 2, F.size(known))).alias("ranks"),
        )

    def step(state: Column, _: Column) -> Column:
        least = F.coalesce(F.array_min(state["ranks"]), F.lit(NO_RANK))
        return F.when(least == NO_RANK, state).otherwise(_let(F.array_position(state["ranks"], least).cast("int"), lambda i: merge(state, i)))

    ids = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: F.array_join(F.transform(state["parts"], lambda x: _found(ranks, x).cast("string")), " "))
    return F.coalesce(_found(ranks, _latin(piece)).cast("string"), ids)  # a piece that has a rank is that token, as the library has it


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges with a heap and linked positions: n log n for a piece of n bytes."""
    n = len(piece)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or ranks.get(piece[i:stop]) != rank:
            continue
        end[i], after[i], alive[j] = stop, after[j], False
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := ranks.get(piece[before[i] : stop])) is not None:
            heapq.heappush(heap, (r, before[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def frequent_words(docs: DataFrame, ranks: Column, most: int = CACHED, sample_docs: int = SAMPLE_DOCS) -> dict[str, str]:
    """The most frequent words of a sample of the documents with their ids, folded once each."""
    some = sample_below(docs, "doc_id", sample_docs).select(F.explode(F.regexp_extract_all("text", F.lit(pattern()), F.lit(0))).alias("word"))
    top = some.where(F.octet_length("word") <= CACHED_BYTES).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(most)
    got = top.repartition(max(2, docs.sparkSession.sparkContext.defaultParallelism), "word").select("word", fold(F.col("word"), ranks).alias("ids")).toArrow()
    return dict(zip(got.column("word").to_pylist(), got.column("ids").to_pylist(), strict=True))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, text, said: the ids of each whole text, joined by blanks."""
    rows = pick(docs, id_col, text_col)
    table = read_ranks(path)
    ranks = _bucketed({k.decode("latin-1"): v for k, v in table.items()}, "int")
    cache = _bucketed(frequent_words(rows, ranks, sample_docs=sample_docs), "string")
    split = rows.withColumn("pieces", F.regexp_extract_all("text", F.lit(pattern()), F.lit(0)))
    short = lambda p: F.coalesce(_found(cache, p), fold(p, ranks))
    @F.pandas_udf("array<string>")
    def merged(column: pd.Series) -> pd.Series:
        own = read_ranks(path)
        return column.map(lambda words: None if words is None else [" ".join(map(str, merge_long(w.encode("utf-8", "surrogatepass"), own))) for w in words])

    rest = split.withColumn("words", F.filter("pieces", lambda p: F.octet_length(p) > LONG))
    rest = rest.withColumn("ids", merged("words"))
    known = lambda p: F.element_at("ids", F.array_position("words", p).cast("int"))
    said = F.transform("pieces", lambda p: F.when(F.octet_length(p) > LONG, known(p)).otherwise(short(p)))
    return rest.select("doc_id", "text", F.array_join(said, " ").alias("said"))


def ids_of(said: str | Column) -> Column:
    """The ids as array<int>."""
    return F.when(F.col(said) == "", F.array().cast("array<int>")).otherwise(F.split(said, " ").cast("array<int>"))


def decode(said: str, path: str) -> Column:
    """The bytes of ids joined by blanks: byte pieces looked up and concatenated."""
    by_rank = sorted(read_ranks(path).items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks have gaps")
    pieces = F.split(F.lit(",".join(b.hex().upper() for b, _ in by_rank)), ",")
    ids = F.filter(F.split(said, " "), lambda x: x != "")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), ""))


def digest(docs: DataFrame) -> DataFrame:
    path = vocabulary_path()
    said = encode(docs, path)
    n = F.when(F.col("said") == "", F.lit(0)).otherwise(F.length("said") - F.length(F.replace("said", F.lit(" "), F.lit(""))) + 1)
    return said.select("doc_id", n.cast("long").alias("n_tokens"), F.sha2("said", 256).alias("ids_sha256"), F.sha2(decode("said", path), 256).alias("decoded_sha256"))
