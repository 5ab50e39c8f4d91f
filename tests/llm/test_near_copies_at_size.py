"""The n-gram Jaccard join where no side is small enough for a broadcast or a single task."""

from __future__ import annotations

import random

from test_near_copies import brute, texts

from gleanery import storage
from gleanery.llm import ngram_join
from gleanery.operators import components


def documents(spark):
    rng = random.Random(8)
    rows = [(i * 3, t) for i, t in enumerate(texts(8))]
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (4, None), (5, " "), (rows[4][0], rows[9][1])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_groups_without_broadcasts_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 6)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(components, "ONE_TASK_EDGES", 0)
    rows, docs = documents(spark)
    assert sorted(map(tuple, ngram_join.jaccard_groups(docs, 3, 90).collect()), key=str) == brute(rows, 3, 90)
