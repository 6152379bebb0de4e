"""Operators against brute force, exact round trips and held-out accuracy; odd cases of each."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veritrove.llm import ann_search, byte_bpe, language_id, packing, secret_scan, simhash_dedup, token_files, toxicity, winnowing
from veritrove.llm import components as components_module
from veritrove.llm.components import components
from veritrove.llm.tokens import END_ID, encode_with_end, encoder, vocabulary_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, score string"


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    long = "word " * 30_000 + "x" * 5_000
    rows = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (5, "Ünï 日本 ΣΑΣ İ \x1c!"), (6, long), (6, long), (None, "no id here"), (7, "same text twice"), (8, "same text twice")]
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


DIGESTS = [secret_scan.digest, winnowing.digest, byte_bpe.digest, token_files.digest, packing.digest, simhash_dedup.digest, language_id.digest]


@pytest.mark.parametrize("digest", DIGESTS, ids=lambda f: f.__module__.rsplit(".", 1)[-1])
def test_odd_and_empty_tables(odd, empty, digest):
    assert digest(odd).count() >= 10
    assert digest(empty).count() == 0


def test_secret_scan(docs, texts, odd):
    for d in (docs, odd):
        want = {r["doc_id"]: secret_scan.brute_force(r["text"]) for r in d.select("doc_id", "text").collect()}
        for r in secret_scan.digest(d).collect():
            spans, digest = want[r["doc_id"]]
            assert r["base_sha256"] == digest
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x for _, k, _ in spans) for x in ("assign", "access", "hex")]


def test_trigram_queries():
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert b"tok" in secret_scan.query_trigrams(secret_scan.trigram_query(secret_scan.BASE[0].pattern))


def test_winnowing(docs, texts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in winnowing.digest(docs, per_range=100).collect()}
    assert len(got) == len(ids)
    for k, i in enumerate(ids):
        t, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        assert got[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        if t == nxt:
            assert got[i]["near_next"] == 1 and got[i]["fingerprint"] == got[ids[(k + 1) % len(ids)]]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95


def test_winnowing_guarantee(spark):
    shared = "alpha beta gamma delta epsilon zeta eta theta"  # K + WINDOW - 1 words
    df = spark.createDataFrame([(1, f"one two {shared} three"), (2, f"{shared} four five six seven")], "doc_id long, text string")
    a, b = (set(r["hashes"]) for r in winnowing.fingerprints(df).orderBy("doc_id").collect())
    assert a & b


def test_byte_bpe(docs, odd, texts):
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for d in (docs.where("doc_id % 5 = 0"), odd):
        want = {r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()}
        for r in byte_bpe.digest(d).collect():
            ids = enc.encode_ordinary(want[r["doc_id"]])
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r["decoded_sha256"] == hashlib.sha256(want[r["doc_id"]].encode()).hexdigest()


def test_token_files(docs, odd, texts):
    library = encoder(vocabulary_path()).library
    start = 0
    for r in token_files.digest(docs).orderBy("doc_id").collect():
        ids = [*library.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    want = {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.select("doc_id", "text").collect()}
    assert all(r["n_tokens"] == want[r["doc_id"]] for r in token_files.digest(odd).collect())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aAbs'tredvlm  \n\t.!-,012éßİÞ\xa0\x85\x00Ⱥ²½ʼ’Σ日\u0301", max_size=25), min_size=1, max_size=4))
def test_word_encoder_matches_its_library(texts):
    own = encoder(vocabulary_path())
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == own.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=600))
def test_blocks_round_trip(ids):
    x = np.array(ids, dtype=np.uint32)
    starts, payload = token_files.pack_blocks(x)
    assert (token_files.unpack_blocks(starts, np.frombuffer(payload, np.uint8))[: len(x)] == x).all()
    raw = token_files.write_segment(np.array([1]), np.array([len(x)]), x)
    assert (token_files.read_range(raw, len(x) // 3, len(x)) == x[len(x) // 3 :]).all()


def test_packing(docs, texts):
    library = encoder(vocabulary_path()).library
    rows = packing.digest(docs).collect()
    sequences, seen = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAP
    for d, parts in seen.items():
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert set(seen) == set(texts)
    total = sum(r["length"] for r in rows)
    assert sum(packing.padding(sum(n for _, n in s)) for s in sequences.values()) < 0.03 * total


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_holds_every_class(histogram):
    found, got = packing.plan(histogram, 64), {}
    for p, n in zip(found.patterns, found.times, strict=True):
        assert sum(c * k for c, k in p.items()) <= 64
        for c, k in p.items():
            got[c] = got.get(c, 0) + k * n
    assert got == histogram


def test_ann_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    got = {}
    for r in ann_search.search(rows).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = []
    for q, found in got.items():
        want = sorted((float(np.sqrt(((v - data[q]) ** 2).sum())), i) for i, v in data.items() if i != q)[:10]
        assert len(found) == 10
        hits.append(len({i for _, i in want} & {i for _, i, _ in found}) / 10)
        assert all(abs(s - np.sqrt(((data[i] - data[q]) ** 2).sum())) < 1e-9 for _, i, s in found)
    assert set(got) == {i for i in data if i % 100 == 0} and np.mean(hits) >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (8, [])]
    got = ann_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, 5, 0.0), (0, 6, 0.0)]
    assert ann_search.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_toxicity(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.digest(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.95
    assert toxicity.kernel("idiot", "idxiot") > 0.4 > toxicity.kernel("idiot", "table")
    u = toxicity.units(["You i d i o t, st*pid 5cum!", None])
    assert toxicity.spell(u).tolist() == ["you", "idiot", "stpid", "scum"]
    assert toxicity.digest(docs.limit(0), labels.limit(0)).count() == 0


def test_simhash_components(docs, odd):
    for d in (docs, odd):
        rows = simhash_dedup.digest(d).collect()
        words = np.array([int(r["fingerprint"], 16) for r in rows], dtype=np.uint64)
        near = np.bitwise_count(words[:, None] ^ words[None]) <= simhash_dedup.LIMIT
        group = np.arange(len(rows))
        while True:
            new = np.array([group[n].min() for n in near])
            if (new == group).all():
                break
            group = new
        want = {g: min((r["doc_id"] for r, x in zip(rows, group, strict=True) if x == g and r["doc_id"] is not None), default=None) for g in set(group.tolist())}
        assert all(r["component_id"] == want[g] for r, g in zip(rows, group.tolist(), strict=True))


@pytest.mark.parametrize("last", ["same", "word{}"])
def test_toxicity_of_rare_insults_beside_copies(spark, last):
    """Copies (or near copies) of one long toxic text hold more words than insults do, in more documents than an insult."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("aeioubdfglmnprst"), 7))
    plain, insults, long = [word() for _ in range(120)], ["zukwex", "qyvock", "wyzzak", "kohwyc", "vexhoq", "jowkux"], " ".join(word() for _ in range(600))
    some = lambda: " ".join(rng.choice(plain, 12))
    toxic = [f"{some()} {insults[i % 6]} {some()}" for i in range(60)] + [f"{long} {last.format(i)}" for i in range(30)]
    clean = [some() for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(toxic + clean))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert set(insults) <= set(model.witnesses)
    assert (toxicity.score_texts([f"so {w} he said" for w in insults], model) >= toxicity.THRESHOLD).all()


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_components_of_few_links_take_few_jobs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    links = [(int(a), int(b)) for a, b in rng.integers(-900, 900, (800, 2))] + [(i, i + 1) for i in range(2000, 2300)] + [(5, 5), (None, 1), (1 << 62, -(1 << 62))]
    table = spark.createDataFrame(links, "a long, b long")
    spark.sparkContext.setJobGroup("components", "components")
    try:
        got = sorted(map(tuple, components(table).collect()))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) <= 12
    monkeypatch.setattr(components_module, "DRIVER_LINKS", -1)
    assert sorted(map(tuple, components(table).collect())) == got  # by rounds, as for more links


def test_language_id(docs, odd):
    got = language_id.digest(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.9
    by = {r["doc_id"]: r["lang_pred"] for r in language_id.digest(odd).collect()}
    assert by[1] == by[2] == by[3] == "und"


def test_near_duplicates_of_null_and_repeated_ids(spark):
    from veritrove.llm import stages

    text = lambda k: " ".join(f"w{(i * 31 + k * 977) % 1009}" for i in range(80))
    a, b, c, d, e = map(text, range(5))
    rows = [(None, a), (None, a), (3, a), (4, b), (4, b), (5, c), (5, a), (None, d), (None, d), (None, e)]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages.drop_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == sorted([(3, a), (4, b), (5, c), (0, d), (0, e)])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = docs.collect()
    assert len(kept) > 700 and not any(secret_scan.brute_force(r["text"])[0] for r in kept)


def test_pipeline_runs_to_packed_sequences(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = dict(zip(kept, encode_with_end(list(kept.values()), vocabulary_path(), END_ID), strict=True))
    of, filled = {}, {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
        of.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {d: sum(n for _, n in p) for d, p in of.items()} == {d: len(x) for d, x in ids.items()}
    for spans in (*of.values(), *filled.values()):
        ends = [a + n for a, n in sorted(spans)]
        assert [a for a, _ in sorted(spans)] == [0, *ends[:-1]]
    assert all(max(a + n for a, n in x) <= packing.CAP for x in filled.values())
