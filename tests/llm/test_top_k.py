"""Hamming top-k against brute force: blocks of several sizes, ties, repeated ids and codes, clashing columns."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import hamming_topk


@pytest.mark.parametrize(("bits", "block", "chunk", "n_segments"), [(64, 1 << 16, 1 << 16, None), (64, 20, 3, None), (40, 8, 1 << 16, 2), (24, 50, 7, 5), (70, 30, 5, None)])
def test_search_is_brute_force(spark, monkeypatch, bits, block, chunk, n_segments):
    monkeypatch.setattr(hamming_topk, "BLOCK", block)
    monkeypatch.setattr(hamming_topk, "CHUNK", chunk)
    rng = random.Random(bits + block)
    base = [[rng.gauss(0, 1) for _ in range(bits)] for _ in range(6)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(bits)]) for i in range(150)]
    rows += [(150 + i, [x if rng.random() < 0.95 else -x for x in base[i % 6]]) for i in range(150)]
    rows += [(300 + i, base[i % 2]) for i in range(40)]  # more equal codes than k
    rows += [(7, base[3]), (7, rows[7][1]), (None, base[0]), (400, None)]  # an id on two codes, a repeated row
    docs = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, code int, query string, block int")
    got: dict = {}
    for r in hamming_topk.top_k(docs, F.col("vec_id") % 20 == 0, k=6, bits=bits, n_segments=n_segments).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    known = {(i, tuple(x > 0 for x in v)) for i, v in rows if i is not None and v is not None}
    for q, code in known:
        if q % 20 == 0:
            want = sorted((sum(a != b for a, b in zip(code, c, strict=True)), i) for i, c in known if i != q)[:6]
            assert [(d, i) for _, d, i in sorted(got[q])] == want
    assert set(got) == {i for i, _ in known if i % 20 == 0}


def test_steps_take_each_radius_of_each_segment_once():
    parts = hamming_topk._segments(64, 5)
    assert parts[0][0] == 0 and sum(w for _, w in parts) == 64 and all(a[0] + a[1] == b[0] for a, b in zip(parts[:-1], parts[1:], strict=True))
    jobs = hamming_topk._steps(parts)
    flat = [x for job in jobs for x in job]
    assert flat == [(s, r) for r in range(14) for s, (_, w) in enumerate(parts) if r <= w]
    assert len(jobs) < 30 and all(len(hamming_topk._masks(w, r)) == math.comb(w, r) for w, r in ((5, 0), (5, 2), (5, 5)))
    assert set(np.bitwise_count(hamming_topk._masks(9, 4)).tolist()) == {4}
