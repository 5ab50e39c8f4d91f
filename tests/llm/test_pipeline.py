"""The corpus pipeline against a brute-force version of its stages, over the smallest tables."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from gleanery.llm import common as C
from gleanery.llm import quality_fm, queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")


def _groups(texts: dict[int, str], n: int, percent: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            o = len(sets[i] & sets[j])
            if j < i and o and 100 * o >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def _taken(rows: list) -> dict[int, tuple[int, int]]:
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r.doc_id)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i in by[s]) for s in order}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, live, target = Fraction(3 * sum(total.values()), 2), set(order), {}
    while live:
        share = left / sum(weight[s] for s in live)
        full = {s for s in live if share * weight[s] >= 2 * total[s]}
        for s in full or live:
            target[s] = 2 * total[s] if full else share * weight[s]
        left -= sum(target[s] for s in full)
        live = live - full if full else set()
    out = {}
    for s in order:
        take, at = int(target[s]), 0
        for i in sorted(by[s], key=lambda i: (int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:15], 16), i)):
            out[i] = (min(size[i], max(0, take - at)) + min(size[i], max(0, take - total[s] - at)), size[i])
            at += size[i]
    return out


def test_pipeline_is_its_stages(spark):
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    model = quality_fm.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"), "quality", ~queries._held_out(), meta_cols=queries.QUALITY_META)
    score = model.score(*quality_fm.features(*C.flat(pa.array([r.text for r in rows])), [np.array([r.n_chars for r in rows], float)], model.bits))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= queries.QUALITY_THRESHOLD]
    group = _groups({r.doc_id: r.text or "" for r in rows}, 5, 80)
    rows = [r for r in rows if group[r.doc_id] == r.doc_id]
    taken = _taken(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in rows:
        n, size = taken[r.doc_id]
        ids = sp.encode(r.text or "")
        want += [(r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))] * (int(n / size + 0.5) if size else 1)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(DATA)).collect())
    assert got == sorted(want) and len({x[0] for x in got}) > 50


def test_stages_take_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a few words here", "en", "src0", 16), (5000, "", "en", None, 0), (5001, "twice the same row", "en", "s", 18), (5001, "twice the same row", "en", "s", 18)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(DATA))
        assert out.columns == docs.columns
        assert out.where("doc_id = 5001").count() <= 4  # two rows, each taken twice at most
    assert corpus_pipeline.near_duplicates(spark, odd, str(DATA)).where("doc_id = 5001").count() == 1
    assert all(stage(spark, odd.limit(0), str(DATA)).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_stages_keep_clashing_columns_and_texts_without_words(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    blank = spark.createDataFrame([(9001, None, "en", "src0", None), (9002, "", "en", None, 0), (9003, " \n ", None, "src1", 3)], docs.schema)
    names = ["score", "_id", "_times", "_n", "_copy", "m0", "key", "Times", "copy", "nth", "sigs", "need", "class", "size", "h", "label", "part", "n_shingles", "component_id"]
    wide = docs.unionAll(blank).withColumns({c: F.concat(F.lit(c), "doc_id") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, str(DATA))
        rows = out.collect()
        assert out.columns == wide.columns and len(rows) > 20
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
        if name != "quality":
            assert sorted(r.doc_id for r in rows if r.doc_id > 9000) == [9001, 9002, 9003]
    assert corpus_pipeline.tokens(spark, wide, str(DATA)).count() == 123
