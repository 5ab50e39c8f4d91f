"""Connected components of a graph of ids: small graphs in one task, others by large-star and small-star rounds.

A graph of at most ``ONE_TASK_EDGES`` distinct edges is solved by union-find in
one task, whose size this constant bounds. In larger ones each round joins every node's larger neighbours to its smallest neighbour, and
then its smaller ones; rounds end when no edge changes. The smallest neighbour
comes from an aggregation with a partial step and goes back by a join, so no
node's neighbours meet in one task. Edges of each round are written to the
shared folder; nothing but counts reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.storage import materialize, release, sized

#: Distinct edges up to which one task finds the components: 8 MB of ids.
ONE_TASK_EDGES = 500_000


def _written(least: DataFrame) -> DataFrame:
    """As a table, so that a join with it can split the edges of a hot node over tasks."""
    return materialize(least, "components-least")


def _star(edges: DataFrame, large: bool, scratch: list[DataFrame]) -> DataFrame:
    """``edges`` has u > v. Large star: neighbours above u go to u's least; small star: those below, and u itself. ``scratch`` gets the table that the result is read from."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")))
        scratch.append(least)
        out = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = _written(edges.groupBy("u").agg(F.min("v").alias("m")))
        scratch.append(least)
        out = edges.join(least, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def _in_one_task(edges: DataFrame) -> DataFrame:
    """node and component by union-find: every root takes the least root that it meets, until none changes."""
    kind = edges.schema["u"].dataType.simpleString()

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # nested, so that workers need not import this package
        held = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
        u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := root[root], root):
                root = up
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "component"])

    out = materialize(edges.select("u", "v").coalesce(1).mapInArrow(solve, f"node {kind}, component {kind}"), "components-nodes")
    release(edges)
    return out


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node and component (its smallest id) of each id that an edge names."""
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = materialize(edges, "components")
    mark = _mark(edges)
    if 0 < mark[0] <= ONE_TASK_EDGES and edges.schema["u"].dataType.typeName() in ("long", "integer"):
        # two nodes an edge at most
        return sized(_in_one_task(edges), 2 * mark[0])
    for _ in range(max_rounds):
        if not mark[0]:
            break
        scratch: list[DataFrame] = [edges]
        large = materialize(_star(edges, True, scratch), "components-large")
        edges = materialize(_star(large, False, scratch), "components")
        release(large, *scratch)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return sized(found, 2 * mark[0])


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free sums: equal marks mean equal edges."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1))), F.sum(F.xxhash64("v", "u", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1)))).first()
    return tuple(row)
