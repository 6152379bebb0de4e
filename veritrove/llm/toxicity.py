"""Toxicity: a support vector machine over a gap-weighted subsequence string kernel, with Nyström landmarks.

Units are words of folded letters: case and a few look-alike digits and signs are folded, other signs within a word are
dropped ("st*pid"), and runs of single letters are one unit ("i d i o t"). The kernel of two units is the inner product
of their subsequences of three letters (word ends count as a letter) that span at most SPAN places, each weighted by
DECAY for every place skipped, over the root of what a unit of that length weighs. So an inserted or missing character
lowers the kernel without ending it.

Training works on a bounded sample of labelled documents (MOST_TOXIC, MOST_CLEAN, those with the smallest hash of the text);
equal texts are one document, toxic if one of them is labelled so.
A toxic document is a bag of units of which one at least is toxic: witnesses are chosen greedily, each the unit that
explains most toxic documents so far unexplained and is as good as absent from clean ones; all units are candidates. Landmarks are the witnesses
and clean units; a unit's features are its kernels with the landmarks times the inverse root of the landmarks' own
kernel matrix. The machine is trained on witnesses against clean units, then again with the clean units that it had
scored highest. Its decision is linear in the subsequence weights, so it folds into one vector over letter triples, which
is what scoring sends to the executors.

A document's score is the logistic of SLOPE times the largest decision of its units. Whole texts are scored.

Cases: null and empty texts, and texts without a unit of letters, get the score of a decision of -1; equal texts get equal
scores; without toxic or clean labels every text gets that score too; rows that share a doc_id are scored each by itself.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, pick, sample_below, slabs

LETTERS = 28  # word end, a-z, any other letter
SPAN = 5
DECAY = 0.5
MOST_TOXIC, MOST_CLEAN = 1500, 3000
MOST_NEGATIVES = 4000
LANDMARKS = 256
#: A witness explains at least this share of the toxic documents, and is this many times likelier there than in clean ones.
LEAST_SHARE, LEAST_RATIO = 0.004, 20.0
#: Units in so large a share of the toxic documents are witnesses too, unless their documents hold more than so many such units.
COMMON_SHARE, COMMON_WORDS = 0.05, 6
SLOPE = 3.0
THRESHOLD = 0.7
STEPS = [(a, s) for s in range(2, SPAN + 1) for a in range(1, s)]
FOLD = str.maketrans("0134578@$", "oieastbas")


def _table() -> np.ndarray:
    """Code point -> letter (1..27), 0 for white space, 255 for what is dropped."""
    t = np.full(0x3000, LETTERS - 1, dtype=np.uint8)
    t[:0x80] = 255
    t[0x80:0xC0] = 255
    t[0x2000:0x2070] = 255
    for c in (*b" \t\n\r\x0b\x0c", 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F):
        t[c] = 0
    for k, c in enumerate(string.ascii_lowercase, 1):
        t[ord(c)] = t[ord(c.upper())] = k
    for a, b in FOLD.items():
        t[a] = b - 96
    return t


TABLE = _table()


@dataclass(frozen=True)
class Units:
    """Letters of all units of some texts, each unit between word ends; where units start, and each unit's text."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    text: np.ndarray


def units(texts: list[str | None]) -> Units:
    padded = [f" {t or ''}\n" for t in texts]
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(p) for p in padded])
    code = TABLE[np.minimum(cp, len(TABLE) - 1)]
    keep = code != 255
    code, owner = code[keep], owner[keep]
    # tokens are runs of letters between white space (each text begins and ends with some)
    first = np.flatnonzero((code != 0) & (np.r_[0, code[:-1]] == 0))
    last = np.flatnonzero((code != 0) & (np.r_[code[1:], 0] == 0)) + 1
    if not len(first):
        return Units(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
    size, of = last - first, owner[first]
    glued = np.r_[False, (size[1:] == 1) & (size[:-1] == 1) & (of[1:] == of[:-1])]
    head = np.flatnonzero(~glued)
    total = np.add.reduceat(size, head)
    starts = np.cumsum(total + 2) - (total + 2)
    letters = np.zeros(int((total + 2).sum()), dtype=np.uint8)
    unit = np.repeat(np.arange(len(head)), total)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(total) - total, total)
    letters[starts[unit] + 1 + inside] = code[code != 0]
    return Units(letters, starts, total + 2, of[head])


def _weight_of(sizes: np.ndarray) -> np.ndarray:
    """The root of what all subsequences of a unit weigh if they are distinct."""
    total = np.zeros(len(sizes))
    for _, s in STEPS:
        total += np.maximum(sizes - s, 0) * DECAY ** (2 * (s - 2))
    return np.sqrt(np.maximum(total, 1e-9))


def decisions(u: Units, weights: np.ndarray) -> np.ndarray:
    """The inner product of each unit's normed subsequence vector with the weights of all triples."""
    if not len(u.starts):
        return np.zeros(0)
    c = u.letters.astype(np.int32)
    total = np.zeros(len(c), dtype=np.float32)
    unit = np.repeat(np.arange(len(u.starts), dtype=np.int32), u.sizes)
    wide = c * (LETTERS * LETTERS)
    mid = c * LETTERS
    for s in range(2, SPAN + 1):
        if len(c) <= s:
            break
        got = np.zeros(len(c) - s, dtype=np.float32)
        ends = wide[:-s] + c[s:]
        for a in range(1, s):
            got += weights[ends + mid[a : len(c) - s + a]]
        got *= unit[:-s] == unit[s:]
        total[: len(got)] += np.float32(DECAY ** (s - 2)) * got
    return np.add.reduceat(total, u.starts) / _weight_of(u.sizes)


def subsequences(words: list[str]) -> np.ndarray:
    """Normed subsequence vectors of a few words (letters as units() folds them), words x triples."""
    out = np.zeros((len(words), LETTERS**3))
    for i, w in enumerate(words):
        u = units([w])
        c = u.letters.astype(np.int64)
        for a, s in STEPS:
            if len(c) > s:
                np.add.at(out[i], c[:-s] * LETTERS**2 + c[a : len(c) - s + a] * LETTERS + c[s:], DECAY ** (s - 2))
        if len(c):
            out[i] /= _weight_of(np.array([len(c)]))[0]
    return out


def kernel(a: str, b: str) -> float:
    x = subsequences([a, b])
    return float(x[0] @ x[1])


ALPHABET = np.array(list(" " + string.ascii_lowercase + "æ"))


def spell(u: Units) -> np.ndarray:
    """Each unit as a text of folded letters."""
    whole = "".join(ALPHABET[u.letters])
    return np.array([whole[a + 1 : a + n - 1] for a, n in zip(u.starts.tolist(), u.sizes.tolist(), strict=True)], dtype=object)


def _train(positive: np.ndarray, weight: np.ndarray, negative: np.ndarray, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """A linear machine with hinge loss: averaged subgradient steps, both classes of equal weight, from a fixed order."""
    x = np.vstack([positive, negative])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    c = np.r_[weight / weight.sum(), np.full(len(negative), 1 / len(negative))]
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, mean, reg = np.zeros(x1.shape[1]), np.zeros(x1.shape[1]), 2e-4
    for t in range(1, rounds + 1):
        short = (x1 @ w) * y < 1
        grad = reg * np.r_[w[:-1], 0] - (c[short] * y[short]) @ x1[short]
        w = w - grad * 20 / np.sqrt(t + 9)
        if t > rounds // 2:
            mean += w
    mean /= rounds - rounds // 2
    return mean[:-1], float(mean[-1])


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of letter triples, float32
    bias: float
    witnesses: tuple[str, ...] = ()


NO_MODEL = Model(np.zeros(LETTERS**3, np.float32), -1.0)


def _rows_of_units(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, unit): the distinct units of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch):
                u = units(part.column("text").to_pylist())
                pairs = sorted(set(zip(u.text.tolist(), spell(u).tolist(), strict=True)))
                of = pa.array([i for i, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(of), part.column("toxic").take(of), pa.array([w for _, w in pairs], pa.string())], ["doc_id", "toxic", "unit"])

    return rows.select("doc_id", "toxic", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, toxic int, unit string").where("length(unit) >= 2")


def _witnesses(pairs: DataFrame, total: int) -> list[tuple[str, int]]:
    """Greedy cover of the toxic documents by units; pairs: doc_id, unit and n1 (the documents of the unit), each pair once.

    Units of the same documents cover alike, so one of them (the first by name) goes to the driver, with its documents.
    """
    least = max(2, LEAST_SHARE * total)  # a unit of fewer documents is never chosen
    sets = pairs.where(F.col("n1") >= least).groupBy("unit").agg(F.sort_array(F.collect_set("doc_id")).alias("docs")).groupBy("docs").agg(F.min("unit").alias("unit")).orderBy("unit").collect()
    at = {d: i for i, d in enumerate(sorted({d for r in sets for d in r["docs"]}))}
    member = np.zeros((len(sets), len(at)), dtype=bool)
    for i, r in enumerate(sets):
        member[i, [at[d] for d in r["docs"]]] = True
    out = []
    while member.size:
        counts = member.sum(1)
        best = int(counts.argmax())  # the first by name among equals
        if counts[best] < least:
            break
        out.append((sets[best]["unit"], int(counts[best])))
        member = member[:, ~member[best]]
    common = pairs.where(F.col("n1") >= COMMON_SHARE * total)
    together = common.groupBy("doc_id").agg(F.count(F.lit(1)).alias("together"))
    # words of one much copied document come along with dozens of others; insults of a vocabulary do not
    few = common.join(together, "doc_id").groupBy("unit").agg(F.max("n1").alias("n1"), F.percentile("together", F.lit(0.5)).alias("half")).where(F.col("half") <= COMMON_WORDS)
    chosen = {w for w, _ in out}
    return [*out, *((r["unit"], r["n1"]) for r in few.orderBy("unit").collect() if r["unit"] not in chosen)]


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """doc_id (the hash of the text), toxic, text: distinct labelled texts."""
    named = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = pick(docs, id_col, text_col).withColumn("key", F.xxhash64("text"))
    labelled = cut(hashed.select("doc_id", "key").join(named.where("toxic IS NOT NULL"), "doc_id").groupBy("key").agg(F.max("toxic").alias("toxic")))
    some = sample_below(labelled.where("toxic = 1"), "key", MOST_TOXIC).unionByName(sample_below(labelled.where("toxic = 0"), "key", MOST_CLEAN))
    return hashed.join(F.broadcast(some), "key").groupBy("key", "toxic").agg(F.max("text").alias("text")).withColumnRenamed("key", "doc_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled documents given; label 1 is toxic, 0 is not, null is no label."""
    rows = cut(_rows_of_units(_sample(docs, labels, id_col, text_col, label_col)))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return NO_MODEL
    counts = rows.groupBy("unit").agg(F.count_distinct(F.when(F.col("toxic") == 1, F.col("doc_id"))).alias("n1"), F.count_distinct(F.when(F.col("toxic") == 0, F.col("doc_id"))).alias("n0"))
    ratio = ((F.col("n1") + 0.5) / (n1 + 1)) / ((F.col("n0") + 0.5) / (n0 + 1))
    candidates = counts.where((ratio >= LEAST_RATIO) & (F.col("n1") >= 2) & (F.length("unit") >= 3)).select("unit", "n1")
    chosen = _witnesses(cut(rows.where("toxic = 1").select("doc_id", "unit").join(candidates, "unit")), n1)
    if not chosen:
        return NO_MODEL
    clean = counts.where("n0 > 0").select("unit")
    near = [r["unit"] for r in clean.orderBy(F.xxhash64("unit")).limit(MOST_NEGATIVES).collect() if r["unit"] not in {w for w, _ in chosen}]
    words, often = [w for w, _ in chosen], np.sqrt([n for _, n in chosen])
    marks = [*words, *near[: max(0, LANDMARKS - len(words))]]
    at_marks = subsequences(marks)
    value, vector = np.linalg.eigh(at_marks @ at_marks.T)
    value = np.maximum(value, 1e-9)
    root = vector @ np.diag(np.where(value > 1e-6 * value.max(), value**-0.5, 0)) @ vector.T
    model = NO_MODEL
    for again in (False, True, True):
        if again:
            near = list(dict.fromkeys([*near[: MOST_NEGATIVES // 2], *_highest(clean, model, MOST_NEGATIVES // 2, set(words))]))
        if not near:
            return NO_MODEL
        features = lambda ws: np.vstack([subsequences(ws[i : i + 200]) @ at_marks.T @ root for i in range(0, len(ws), 200)])
        w, b = _train(features(words), often, features(near))
        model = Model((at_marks.T @ (root @ w)).astype(np.float32), b, tuple(words))
    return model


def _highest(clean: DataFrame, model: Model, most: int, but: set[str]) -> list[str]:
    """The clean units of the sample with the highest decisions."""
    sent = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, "unit"):
                u = units(part.column("unit").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("unit").take(pa.array(u.text)), pa.array(decisions(u, sent.value.weights).astype(np.float64))], ["unit", "d"])

    top = clean.mapInArrow(run, "unit string, d double").orderBy(F.desc("d"), "unit").limit(most)
    return [r["unit"] for r in top.collect() if r["unit"] not in but]


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    u = units(texts)
    top = np.full(len(texts), -1.0)
    if len(u.starts):
        new = np.flatnonzero(np.r_[True, u.text[1:] != u.text[:-1]])
        top[u.text[new]] = np.maximum(np.maximum.reduceat(decisions(u, model.weights) + model.bias, new), -1.0)
    return 1 / (1 + np.exp(-SLOPE * top))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, most=1 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(score_texts(part.column("text").to_pylist(), sent.value))], ["doc_id", "score"])

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract: learns labels of documents that are not held out, scores all."""
    held = crc_mod(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held), labels.where(~held))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
