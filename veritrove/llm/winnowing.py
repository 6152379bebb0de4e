"""Document fingerprints by winnowing, with DataFrame functions only.

Words (letters and digits, lower-cased) are hashed; a k-gram's hash is the cyclic polynomial of its K words, a rolling
hash: dropping the first word and adding the next is a rotation and two exclusive-ors. Array functions keep no running
state without copying it, so each value is composed from halves instead of rolled; the values are the same. In every
window of WINDOW k-grams the smallest hash is chosen, of equal ones the rightmost, and kept with its position. So any
run of K + WINDOW - 1 words that two texts share gives a common fingerprint entry.

An entry is one long: 31 bits of hash, then 2^32 - 1 less the position, so that the least long is the least hash and, of
ties, the rightmost. Sliding minima come from doubling: pairs first, then pairs of pairs.

The next document is found without a global window: documents go to ranges of ids (at most MOST_RANGES), each range also
gets the first document of the range below it (a guest), and lead() runs within ranges. Each text is shuffled once.

Cases: null texts are empty; empty texts have no entry, and two empty fingerprints are alike (1); texts without letters or
digits have one entry of their own; texts of under K words are one k-gram. A null doc_id comes last. Rows that share a
doc_id follow one another in order of their texts. A single document is its own next one. An empty table gives no rows.
Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick

K = 5
WINDOW = 4
LOW = (1 << 32) - 1
RANGE_DOCS = 4096
MOST_EDGES, MOST_STEPS = 1024, 64
MOST_RANGES = MOST_EDGES * MOST_STEPS
NULL_ID = -(1 << 63)


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _shifted(name: str, by: int, f) -> Column:
    """f(x[i], x[i + by]) over an array column."""
    n = F.greatest(F.size(name) - by, F.lit(0))
    return F.zip_with(F.slice(name, 1, n), F.slice(name, by + 1, n), f)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the entries of the text column (array<long>, in order of position, each once)."""
    words, a, b, c = (f"__{out}_{x}" for x in "wabc")
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.withColumn(words, found)
    whole = F.when(F.col(text) == "", F.array().cast("array<long>")).when(F.size(words) == 0, F.array(F.xxhash64(text))).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))
    df = df.withColumn(a, F.when(F.size(words) >= K, F.transform(words, lambda w: F.xxhash64(w))).otherwise(whole)).drop(words)
    df = df.withColumn(b, _shifted(a, 1, lambda x, y: _rotate(x, 1).bitwiseXOR(y)))
    df = df.withColumn(c, _shifted(b, 2, lambda x, y: _rotate(x, 2).bitwiseXOR(y))).drop(b)
    n = F.size(a) - (K - 1)
    grams = F.when(n >= 1, F.zip_with(F.slice(c, 1, F.greatest(n, F.lit(0))), F.slice(a, K, F.greatest(n, F.lit(0))), lambda x, y: _rotate(x, 1).bitwiseXOR(y))).otherwise(F.col(a))
    placed = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, 33), 32).bitwiseOR(F.lit(LOW) - i))
    df = df.withColumn(b, placed).drop(a, c)
    df = df.withColumn(a, _shifted(b, 1, lambda x, y: F.least(x, y)))
    least = F.when(F.size(b) >= WINDOW, _shifted(a, 2, lambda x, y: F.least(x, y))).when(F.size(b) > 0, F.array(F.array_min(b))).otherwise(F.col(b))
    return df.withColumn(out, F.array_distinct(least)).drop(a, b)


def hashes(entries: str | Column) -> Column:
    return F.array_distinct(F.transform(entries, lambda x: F.shiftright(x, 32)))


def positions(entries: str | Column) -> Column:
    return F.transform(entries, lambda x: F.lit(LOW) - x.bitwiseAND(F.lit(LOW)))


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two columns of hashes()."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def text_of(entries: str) -> Column:
    return F.sha2(F.array_join(F.transform(entries, lambda x: F.hex(x)), ","), 256)


def _count_below(edges: list[int], key: Column) -> Column:
    """How many of the sorted edges are below the key, by a coarse and a fine scan."""
    if not edges:
        return F.lit(0)
    step = 32
    at = F.size(F.filter(F.array(*map(F.lit, edges[::step])), lambda e: e < key))
    blocks = F.array(*(F.array(*map(F.lit, edges[i : i + step])) for i in range(0, len(edges), step)))
    fine = F.size(F.filter(F.element_at(blocks, F.greatest(at, F.lit(1))), lambda e: e < key))
    return F.when(at == 0, F.lit(0)).otherwise((at - 1) * step + fine)


def id_range(docs: DataFrame, key: str, per_range: int = RANGE_DOCS) -> Column:
    """A number that grows with the key: quantile edges (at most MOST_EDGES), then equal steps between them."""
    n, low, high = docs.agg(F.count(F.lit(1)), F.min(key), F.max(key)).first()
    wanted = -(-n // per_range)
    k = max(1, min(MOST_EDGES, wanted))
    edges = sorted(set(docs.agg(F.percentile_approx(key, [i / k for i in range(1, k)], 100 * k)).first()[0])) if k > 1 else []
    steps = max(1, min(MOST_STEPS, wanted // MOST_EDGES))
    coarse = _count_below(edges, F.col(key))
    if steps == 1 or not n:
        return coarse.cast("long")
    begins, ends = [low, *(e + 1 for e in edges)], [*edges, high]
    at = lambda xs: F.element_at(F.array(*(F.lit(float(x)) for x in xs)), coarse + 1)
    inside = F.floor((F.col(key).cast("double") - at(begins)) * steps / (at(ends) - at(begins) + 1))
    return coarse.cast("long") * steps + F.least(F.lit(steps - 1), F.greatest(F.lit(0), inside))


def with_next(docs: DataFrame, per_range: int = RANGE_DOCS) -> tuple[DataFrame, object]:
    """(doc_id, text, id, range, own) so that each own row is followed, in the window returned, by the next document."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    rows = rows.withColumn("range", id_range(rows, "id", per_range))
    heads = rows.groupBy("range").agg(F.max("id").alias("id"))
    down = Window.orderBy(F.desc("range"))
    lowest = F.min("range").over(Window.partitionBy(F.lit(0)))
    guests = heads.select("id", F.coalesce(F.lag("range").over(down), lowest).alias("guest_of"))
    both = F.array(F.struct("range", F.lit(True).alias("own")), F.struct(F.col("guest_of").alias("range"), F.lit(False).alias("own")))
    one = F.array(F.struct("range", F.lit(True).alias("own")))
    dealt = rows.join(F.broadcast(guests), "id", "left").select("doc_id", "text", "id", F.explode(F.when(F.col("guest_of").isNull(), one).otherwise(both)).alias("to")).select("doc_id", "text", "id", "to.range", "to.own")
    return dealt, Window.partitionBy("range").orderBy(F.desc("own"), F.desc("id"), "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes and positions of each document's fingerprint."""
    df = with_fingerprint(pick(docs, id_col, text_col), "text", "fp")
    return df.select("doc_id", F.transform("fp", lambda x: F.shiftright(x, 32)).alias("hashes"), positions("fp").alias("positions"))


def digest(docs: DataFrame, per_range: int = RANGE_DOCS) -> DataFrame:
    """The contract: each text, its edited text, and how alike their fingerprints and the next document's are."""
    df, order = with_next(pick(docs, "doc_id", "text"), per_range)
    df = df.withColumn("next", F.lead("text").over(order)).withColumn("n", F.length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.left("text", F.col("n") - half), F.left(F.coalesce("next", F.lit("")), half))).drop("next")
    df = with_fingerprint(df, "text", "fp")
    df = df.withColumn("edited_sha256", F.sha2("edited", 256))
    df = with_fingerprint(df, "edited", "edited_fp").drop("edited")
    df = df.withColumn("own_hashes", hashes("fp")).withColumn("edited_hashes", hashes("edited_fp"))
    df = df.withColumn("near_edited", likeness("own_hashes", "edited_hashes")).drop("edited_hashes")
    df = df.withColumn("next_hashes", F.lead("own_hashes").over(order))  # the same window: no further shuffle or sort
    df = df.where("own").withColumn("near_next", likeness("own_hashes", "next_hashes"))
    return df.select("doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256", text_of("fp").alias("fingerprint"), text_of("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next")
