"""Components of small graphs, solved in one task, and of others, by rounds."""

from __future__ import annotations

import random

import pytest

from gleanery.operators import components as module


def brute(edges: list[tuple]) -> dict:
    root = {x: x for e in edges if e[0] is not None and e[1] is not None and e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a in root and b in root:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {x: find(x) for x in root}


def graphs() -> dict[str, list[tuple]]:
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(-40, 40)]
    shuffled = rng.sample(range(10**12), 60)
    return {
        "none": [],
        "loops and nulls": [(1, 1), (None, 2), (3, None), (None, None)],
        "chain": rng.sample(chain, len(chain)),
        "chain of shuffled ids": list(zip(shuffled, shuffled[1:], strict=False)),
        "star": [(7, i) for i in range(100, 160)] * 2,
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(45)],
    }


@pytest.mark.parametrize("one_task", [True, False])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_components_are_those_of_brute_force(spark, monkeypatch, one_task, kind):
    monkeypatch.setattr(module, "ONE_TASK_EDGES", 500 if one_task else 0)
    edges, want = [], {}
    for k, graph in enumerate(graphs().values()):  # one graph of many components
        at = [tuple(None if x is None else x % 10**6 + 10**7 * (k + 1) for x in e) for e in graph]
        at = [tuple(None if x is None else str(x) for x in e) for e in at] if kind == "string" else at
        edges += at
        want |= brute(at)
    got = module.components(spark.createDataFrame(edges, f"a {kind}, b {kind}"), "a", "b")
    assert [t for _, t in got.dtypes] == [{"long": "bigint"}.get(kind, kind)] * 2
    rows = got.collect()
    assert len(rows) == len(want) and {r.node: r.component for r in rows} == want


def test_no_edges(spark):
    assert module.components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect() == []


def test_small_graphs_take_no_rounds(spark, monkeypatch):
    """A round writes four tables; each costs its jobs as many tasks as there are partitions, however small the graph."""
    written = []
    keep = module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name: written.append(name) or keep(df, name))
    edges = graphs()["chain"]
    got = module.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.component for r in got} == {-40} and len(got) == 81
    assert len(written) <= 2, written
