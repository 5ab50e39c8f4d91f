"""The training-data operators on small tables with nulls, ties, repeated rows, long texts, clashing columns and no rows."""

from __future__ import annotations

import hashlib
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat_format, hamming_topk, licenses, mixing, ngram_join, order_minhash, quality_fm, queries, sentencepiece_codec, sharding, token_files

DATA = Path("/root/testdata/sf0.001")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
BASE = " ".join(WORDS * 2)
SCHEMA = "doc_id long, text string, source string, part int, slot string, h long, n_chars long"


def rows():
    t = [(0, BASE, "b"), (1, BASE, "b"), (2, BASE.replace("kappa", "KAPPA"), "a"), (3, None, None), (4, "", "a"), (5, " \n", None), (6, "one", "c"), (7, "one", "c"), (8, "long " * 3000, "a"), (9, BASE + " omega", "b"), (10, " ".join(reversed(WORDS)), "c")]
    return [(i, x, s, 1, "x", 7, len(x or "")) for i, x, s in t]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert token_files.read(spark, token_files.write(none), digest=True).count() == 0
    assert order_minhash.fingerprints(none).count() == 0
    assert mixing.taken(none).count() == 0
    assert sharding.shard(none).count() == 0
    assert sentencepiece_codec.encode_decode(none).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert ngram_join.jaccard_groups(none).count() == 0
    assert quality_fm.score(none, quality_fm.train(none, labels)).count() == 0
    assert hamming_topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") >= 0).count() == 0
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, seq long, turn long, event string, role string, text string")).count() == 0


def test_token_files(spark, docs):
    from tokenizers import Tokenizer
    import numpy as np
    import public_tokenizers

    ref = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in token_files.read(spark, token_files.write(docs, n_parts=3), digest=True).collect()}
    at = 0
    for i, x, *_ in rows():
        ids = [*ref.encode(x or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in order_minhash.fingerprints(docs).collect()}
    texts = [x or "" for _, x, *_ in rows()]
    for i, t in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1 and got[3].near_next == 1 and got[9].near_next < 0.2


def test_mixing(docs):
    got = {r.doc_id: r for r in mixing.taken(docs).collect()}
    size = {i: len((x or "").split()) for i, x, *_ in rows()}
    assert all(got[i].size == n and 0 <= got[i].taken <= 2 * n for i, n in size.items())
    for s in ("a", "b", "c", None):
        ids = [i for i, _, t, *_ in rows() if t == s]
        assert abs(sum(got[i].taken for i in ids) - got[ids[0]].target) <= 1
    assert {r.doc_id: r.taken for r in mixing.taken(docs.repartition(3)).collect()} == {i: r.taken for i, r in got.items()}


def test_schedule_has_low_discrepancy(spark):
    plan = mixing.targets(spark.createDataFrame([("a", 800), ("b", 500), ("c", 100)], "source string, source_size long"))
    target = {r.source: r.target for r in plan.collect()}
    slots = mixing.schedule(plan, 1000).orderBy("slot").collect()
    for n in (10, 100, 1000):
        for s, t in target.items():
            assert abs(sum(r.source == s for r in slots[:n]) - n * t / sum(target.values())) < 4
    for s in target:
        assert sorted(r["rank"] for r in slots if r.source == s) == list(range(sum(r.source == s for r in slots)))


def test_sharding(docs):
    got = sharding.shard(docs, n_shards=3).collect()
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(3)}
    assert [len(x) for x in by.values()] == [4, 4, 3] and all(x == list(range(len(x))) for x in by.values())
    text = {i: (x or "").encode() for i, x, *_ in rows()}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)


def test_sharding_is_uniform(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    hits = sum(r.shard == 0 for seed in range(3) for r in sharding.shard(df, 4, seed=seed * 10).where("doc_id < 1000").collect())
    assert abs(hits - 750) < 70


def test_groups_of_near_copies(docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(docs, 3, 90).collect()}
    assert {i: c for i, (_, c) in got.items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 0, 10: 10}
    assert got[3][0] == got[4][0] == got[5][0] == 0 and got[6][0] == 1 and got[8][0] == 1


def test_large_components_are_split(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 8)
    texts = []
    for i in range(60):
        words = (WORDS * 5).copy()
        words = [f"{w}{j}" for j, w in enumerate(words)]
        words[i] = f"edit{i}"
        texts.append((i, " ".join(words if i < 50 else [f"z{i}{w}" for w in words])))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(df, 3, 88).collect()}
    assert all(got[i] == 0 for i in range(50)) and all(got[i] == i for i in range(50, 60))


def test_codec_and_licenses(docs):
    got = {r.doc_id: r for r in sentencepiece_codec.encode_decode(docs).collect()}
    assert all(got[i].decoded == (x or "") for i, x, *_ in rows()) and got[3].ids == []
    scan = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert scan[3].n_words == 0 and scan[3].first_word is None and scan[8].n_words == 3000


def test_quality(spark):
    good, bad = "plain words of a calm text number {}. they go on.", "XX## $$$ {} | ||| !!! %%% @@@"
    data = [(i, (good if i % 2 else bad).format(i) * 3, "s", 100 if i % 3 else None) for i in range(300)] + [(300, None, "s", None), (301, "", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(5, 1), (999, 1)], "doc_id long, quality int")
    model = quality_fm.train(docs, labels, sample_key=F.col("doc_id") % 5 != 0, meta_cols=("n_chars",))
    got = {r.doc_id: r.score for r in quality_fm.score(docs, model, meta_cols=("n_chars",)).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(200, 300)) and 0 <= got[300] <= 1 and got[300] == got[301]
    small = quality_fm.train(docs, labels, max_rows=50, meta_cols=("n_chars",))
    assert all((s > 0.5) == bool(i % 2) for i, s in {r.doc_id: r.score for r in quality_fm.score(docs, small, meta_cols=("n_chars",)).collect()}.items() if 200 <= i < 300)


def test_top_k(spark):
    import random

    rng = random.Random(1)
    vecs = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(150)] + [(150, None), (151, [1.0] * 40), (152, [1.0] * 40), (153, [float("nan")] * 40)]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got: dict = {}
    for r in hamming_topk.top_k(df, F.col("vec_id") % 25 == 1, k=7, bits=40).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    code = {i: [x > 0 for x in v] for i, v in vecs if v}
    for q in [i for i in code if i % 25 == 1]:
        want = sorted((sum(a != b for a, b in zip(code[q], code[i], strict=True)), i) for i in code if i != q)[:7]
        assert [(d, i) for _, d, i in sorted(got[q])] == want


def test_chat_events(spark):
    log = [(1, 1, 0, "message", "user", "hi <x>"), (1, 2, 1, "delta", "assistant", "he"), (1, 3, 1, "delta", "assistant", "llo\\"), (1, 4, 2, "message", "user", "more"), (1, 5, 3, "message", "assistant", "gone"), (1, 6, 1, "regenerate", "assistant", "</turn>new"), (1, 7, 1, "delta", "assistant", " end"), (1, 8, 0, "edit", "user", "hey"), (2, 1, 0, None, None, None)]
    df = spark.createDataFrame(log, "conv_id long, seq long, turn long, event string, role string, text string")
    out = chat_format.format_chats(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("m"), chat_format.masked_text(F.col("blocks")).alias("loss"), "formatted")
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(x) for x in got[1].m] == [("user", "hey"), ("assistant", "</turn>new end")]
    assert got[1].loss == "</turn>new end" and [tuple(x) for x in got[2].m] == [("", "")]


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, str(DATA)), con.sql(queries.ORACLE_SQL[name])
    place = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in place) for r in want.fetchall())
