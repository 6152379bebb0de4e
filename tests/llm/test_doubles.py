"""Operators against plain-Python doubles that share no code with them."""

import math

import pytest
import regex
import xxhash

from veritrove.llm import language_id, line_dedup, winnowing

MASK = (1 << 64) - 1


def rotate(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) & MASK


def winnow(text: str) -> list[tuple[int, int]]:
    """(hash, position) of each choice, in order of position."""
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
    if not text:
        return []
    digest = lambda t: xxhash.xxh64_intdigest(t.encode(), 42)
    if len(words) < winnowing.K:
        grams = [digest(" ".join(words) if words else text)]
    else:
        rolling = 0
        grams = []
        hashes = [digest(w) for w in words]
        for i, h in enumerate(hashes):
            rolling = rotate(rolling, 1) ^ h
            if i >= winnowing.K:
                rolling ^= rotate(hashes[i - winnowing.K], winnowing.K)
            if i >= winnowing.K - 1:
                grams.append(rolling)
    short = [g >> 33 for g in grams]
    chosen = []
    for at in range(max(1, len(short) - winnowing.WINDOW + 1)):
        window = short[at : at + winnowing.WINDOW]
        low = min(window)
        where = at + len(window) - 1 - window[::-1].index(low)  # the rightmost
        if not chosen or chosen[-1] != (low, where):
            chosen.append((low, where))
    return chosen


def test_winnowing_is_the_rolling_hash_with_rightmost_ties(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(-1, ""), (-2, "..."), (-3, "a b"), (-4, "a " * 40), (-5, "a b c d e f g h")], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.unionByName(more).collect()}
    for r in winnowing.fingerprints(docs.unionByName(more)).collect():
        assert list(zip(r["hashes"], r["positions"], strict=True)) == winnow(texts[r["doc_id"]])


def grams(text: str) -> list[int]:
    c = [ord(x) for x in f" {text.lower()} "]
    cut = (1 << 32) - 1
    out = []
    for i in range(len(c) - 1):
        two = (c[i] * 0x9E3779B1 & cut) ^ (c[i + 1] * 0x85EBCA77 & cut)
        values = [two]
        if i + 2 < len(c):
            values.append(two ^ (c[i + 2] * 0xC2B2AE3D & cut) ^ 0x27D4EB2F)
        out += [((x ^ (x >> 15)) * 0x2C1B3C6D & cut) >> (32 - language_id.BITS) for x in values]
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, t, lang, 1) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("of the house", "en"), ("and so it goes", "en"), ("der Hund und die Katze", "de"), ("von dem Haus", "de"), (None, "de"), ("no label", None), ("le chat et le chien", "fr")])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_language_id_is_multinomial_naive_bayes(spark, labelled):
    known = [(r["text"], r["lang"]) for r in labelled.collect() if r["text"] and r["lang"]]
    names = sorted({lang for _, lang in known})
    counts = {lang: {} for lang in names}
    for text, lang in known:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    total = {lang: sum(c.values()) + language_id.SMOOTH * (1 << language_id.BITS) for lang, c in counts.items()}
    texts = ["the", "und", "la maison", "x", "İß ΣΑΣ", "it is", "der the le"]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), language_id.fit(labelled)).collect()
    for r in got:
        logs = {lang: math.log(sum(x == lang for _, x in known) / len(known)) + sum(math.log((counts[lang].get(g, 0) + language_id.SMOOTH) / total[lang]) for g in grams(texts[r["doc_id"]])) for lang in names}
        top = max(logs.values())
        share = {lang: math.exp(v - top) for lang, v in logs.items()}
        assert r["lang_pred"] == min(names, key=lambda lang: (-logs[lang], lang))
        assert abs(r["score"] - max(share.values()) / sum(share.values())) < 1e-4


def test_language_id_needs_a_letter_and_keeps_columns(spark, labelled):
    model = language_id.fit(labelled)
    rows = spark.createDataFrame([(1, "½ ²", "a"), (2, "Ⅷ ③ 12", "b"), (3, "the", None), (4, None, "d")], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in language_id.predict(rows.withColumnRenamed("score", "lang"), model, keep=("text", "lang")).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4)] == ["und"] * 3 and got[3]["lang_pred"] == "en"
    assert [(got[i]["text"], got[i]["lang"]) for i in (1, 3, 4)] == [("½ ²", "a"), ("the", None), (None, "d")]


def test_line_dedup_of_odd_and_empty_tables(spark):
    long = "word " * 30_000 + "x" * 5_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n ", "x"), (4, "a", "x"), (5, "Ünï 日本 ΣΑΣ İ \x1c!", "x"), (6, long, "x"), (6, long, "x"), (None, "no id here", "x"), (7, "same text twice", "x"), (8, "same text twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = line_dedup.digest(docs).collect()
    assert len(got) == 10 and sorted(len(r["dropped"]) for r in got if r["doc_id"] == 6) == [0, 1]
    assert {r["doc_id"]: r["n_kept"] for r in got if r["doc_id"] in (1, 2, 3, 4, 7, 8)} == {1: 1, 2: 1, 3: 2, 4: 1, 7: 1, 8: 0}
    assert line_dedup.digest(docs.limit(0)).count() == 0
