"""Levels of graphs that are deeper than a bound."""

from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

from gleanery.operators import graph as G


def _chain(spark, n):
    return spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), spark.range(1).select(F.col("id").alias("node"))


def test_no_node_is_left_out(spark, monkeypatch):
    edges, roots = _chain(spark, 9)
    assert inspect.signature(G.levels).parameters["most"].default is None
    monkeypatch.setattr(G, "LEVELS_A_TABLE", 3)
    roots = roots.unionAll(spark.range(9, 10))
    edges = edges.unionAll(spark.createDataFrame([(0, 2), (3, 3), (20, 21)], "src long, dst long"))
    got = sorted((r.node, r.level) for r in G.levels(edges, roots).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (3, 2), (4, 3), (5, 4), (6, 3), (7, 2), (8, 1), (9, 0)]


def test_a_bound_that_is_too_low_is_an_error(spark):
    edges, roots = _chain(spark, 3)
    assert G.levels(edges, roots, most=3).count() == 4
    with pytest.raises(RuntimeError):
        G.levels(edges, roots, most=2)
