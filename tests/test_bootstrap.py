"""Bootstraps of groups against one group's resamples at a time, and of many groups."""

from __future__ import annotations

import threading

import numpy as np
import pytest

from gleanery.operators import evaluation as E


def _one(values, n, draws, seed=42):
    x = np.sort(np.array(values, float))
    picked = x[np.random.Generator(np.random.PCG64(seed)).integers(0, len(x), (draws, n))]
    hi, lo = picked.max(1), picked.min(1)
    return [hi.mean(), hi.std(), lo.mean(), lo.std()]


def test_groups_of_several_sizes(spark):
    groups = {None: [3.0, 1.0], "a": [5.0], "b": [2.0, 2.0, 7.5, -1.0], "c": [4.0, 9.0], "long": [float(i * 37 % 1009) for i in range(2000)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("null", None), ("null", 1.0)]
    got = {r[0]: list(r)[1:] for r in E.bootstrap(spark.createDataFrame(rows, "g string, v double"), "g", "v", 4, draws=50).collect()}
    assert set(got) == {*groups, "null"} and got["null"] == [None] * 4
    assert all(got[g] == pytest.approx(_one(vs, 4, 50), abs=1e-9) for g, vs in groups.items())


def test_many_groups(spark):
    """80,000 groups in 40 seconds: groups don't go to Python one by one."""
    rows = spark.range(0, 240_000, 1, 4).selectExpr("id div 3 AS g", "double(id * 31 % 101) AS v")
    got = []
    run = threading.Thread(target=lambda: got.extend(E.bootstrap(rows, "g", "v", 4, draws=200).collect()), daemon=True)
    run.start()
    run.join(40)
    assert len(got) == 80_000
    for r in got[:: len(got) // 20]:
        assert list(r)[1:] == pytest.approx(_one([(r.g * 3 + i) * 31 % 101 for i in range(3)], 4, 200), abs=1e-9)
