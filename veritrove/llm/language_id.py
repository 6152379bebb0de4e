"""Language identification: multinomial naive Bayes over hashed character n-grams.

Bigrams and trigrams of code points (lower-cased, with a blank at either end) are hashed into 2^BITS buckets. Training
counts buckets per language on the executors; the driver gets one count for each language and bucket, smooths them into
a log-probability matrix and broadcasts it, with the log share of each language's documents as prior. Its size depends on
the buckets and the languages only. Scoring hashes a slab
of text with numpy, gathers matrix rows and sums them by document.

Training may be bounded: `most_docs` labelled documents with the smallest hash of their id. Scoring covers all texts,
whole.

The score is the posterior of the language predicted. Cases: a null text or one without a letter is `und` with score 0; without any labelled row every text is `und`; equal
texts get equal predictions; ties go to the alphabetically first language. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sample_below, slabs

BITS = 16
MOST_DOCS = 20_000
SMOOTH = 0.1
#: Texts are worked on in slabs of about so many bytes: hashing takes some 80 bytes of memory a byte of text.
SLAB = 512 << 10
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    matrix: np.ndarray  # buckets x languages, float32
    prior: np.ndarray  # log share of each language's documents


def hashed_ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, text by text, and where each text's buckets begin (with the end)."""
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in padded], dtype=np.int64)
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    one = cp * np.uint32(0x9E3779B1)
    two = one[:-1] ^ (cp[1:] * np.uint32(0x85EBCA77))
    three = two[:-1] ^ (cp[2:] * np.uint32(0xC2B2AE3D)) ^ np.uint32(0x27D4EB2F)
    mix = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    ends = np.cumsum(lengths)
    keep2 = np.ones(len(two), dtype=bool)
    keep2[ends[:-1] - 1] = False
    keep3 = np.ones(len(three), dtype=bool)
    for back in (1, 2):
        keep3[ends[:-1] - back] = False
    out = np.empty(int((2 * lengths - 3).sum()), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(2 * lengths - 3)])
    row = np.repeat(np.arange(len(texts)), lengths)
    at2 = np.flatnonzero(keep2)
    at3 = np.flatnonzero(keep3)
    base = ends - lengths
    out[starts[row[at2]] + (at2 - base[row[at2]])] = mix(two[at2])
    out[starts[row[at3]] + (lengths[row[at3]] - 1) + (at3 - base[row[at3]])] = mix(three[at3])
    return out, starts


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = MOST_DOCS) -> Model:
    """Learns from the rows given (at most `most_docs`) whose text and language are not null."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    rows = sample_below(rows, "doc_id", most_docs).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slabs(batch, most=SLAB):
                langs = part.column("lang").to_pylist()
                for lang in langs:
                    docs[lang] = docs.get(lang, 0) + 1
                buckets, starts = hashed_ngrams(part.column("text").to_pylist())
                for lang in set(langs):
                    own = np.concatenate([buckets[starts[i] : starts[i + 1]] for i, x in enumerate(langs) if x == lang])
                    sums[lang] = sums.get(lang, 0) + np.bincount(own, minlength=1 << BITS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            # bucket -1 counts the documents
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array([*at, -1], pa.int32()), pa.array([*c[at], docs[lang]], pa.int64())], ["lang", "bucket", "n"])

    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(got.column("lang").to_pylist(), dtype=object)
    names = tuple(sorted(set(langs)))
    counts = np.zeros((1 << BITS, max(1, len(names))))
    prior = np.ones(max(1, len(names)))
    for k, name in enumerate(names):
        bucket, n = got.column("bucket").to_numpy()[langs == name], got.column("n").to_numpy()[langs == name]
        counts[bucket[bucket >= 0], k] = n[bucket >= 0]
        prior[k] = n[bucket < 0].sum()
    prob = (counts + SMOOTH) / (counts.sum(0) + SMOOTH * (1 << BITS))
    return Model(names, np.log(prob).astype(np.float32), np.log(prior / prior.sum()))


def score_texts(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    known = [bool(t) and bool(model.languages) and LETTER.search(t) is not None for t in texts]
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    some = [i for i, k in enumerate(known) if k]
    if some:
        buckets, starts = hashed_ngrams([texts[i] for i in some])
        total = np.stack([np.add.reduceat(model.matrix[:, k][buckets], starts[:-1], dtype=np.float64) for k in range(len(model.languages))], axis=1) + model.prior
        odds = np.exp(total - total.max(1, keepdims=True))
        best = total.argmax(1)
        scores[some] = odds[np.arange(len(some)), best] / odds.sum(1)
        for i, b in zip(some, best.tolist(), strict=True):
            names[i] = model.languages[b]
    return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slabs(batch, "__text", SLAB):
                names, scores = score_texts(part.column("__text").to_pylist(), sent.value)
                yield pa.RecordBatch.from_arrays([*part.columns[drop:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names[drop:], "lang_pred", "score"])

    drop = 0 if text_col in keep else 1  # a text that is kept is sent once
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), F.col(f"`{id_col}`").alias("doc_id"), *(F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keep) if c != text_col))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[drop:])
    kept = (F.col("__text" if c == text_col else f"__{k}").alias(c) for k, c in enumerate(keep))
    return rows.mapInArrow(run, f"{out}, lang_pred string, score double").select("doc_id", *kept, "lang_pred", "score")


def held_out_column(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def digest(docs: DataFrame) -> DataFrame:
    """The contract: learns from documents that are not held out, predicts all."""
    held = held_out_column(F.col("doc_id"))
    return predict(docs, fit(docs.where(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")


__all__ = ["Model", "digest", "fit", "hashed_ngrams", "held_out_column", "predict", "score_texts"]
