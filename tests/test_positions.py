"""Positions of all rows, where a value of the first key is hot and ranges are many."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import datasets as D


@pytest.mark.parametrize("rows", [10, 200_000])
def test_positions_are_a_sort(spark, monkeypatch, rows):
    monkeypatch.setattr(D, "RANGE_ROWS", rows)
    monkeypatch.setattr(D, "LEAST_RANGES", 5)
    data = [(7 if i % 3 else i, (i * 37) % 900, i) for i in range(900)] + [(None, 5, 900), (7, 5, 901), (7, None, 902)]
    df = spark.createDataFrame(data, "a long, b long, c long")
    got = [(r.a, r.b, r.c) for r in D.with_position(df, ["a", "b", "c"]).orderBy("pos").collect()]
    low = lambda x: (x is not None, x or 0)
    assert got == sorted(data, key=lambda t: tuple(map(low, t)))
    assert D.with_position(df, ["a", "b", "c"]).agg(F.min("pos"), F.max("pos")).first()[:] == (0, 902)


def test_no_rows(spark):
    assert D.with_position(spark.createDataFrame([], "a long"), ["a"]).count() == 0
