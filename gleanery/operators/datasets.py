"""Operators of training sets: concatenation, interleaving, blending, splitting, repeating, sampling, packing, token streams.

Row order is always explicit: a ``row`` or key column says it. Positions of all
rows of a table come from :func:`with_position`, in two levels, so that no
window without a partition sees more than a count for each range.
"""

from __future__ import annotations

import bisect
import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a range of :func:`with_position` holds, and how few and many ranges there are.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 200_000, 64, 4096


def _cuts(values: list | None) -> Column:
    return F.array(*(F.lit(v) for v in sorted(set(values or [])))) if values else F.array().cast("array<double>")


def with_position(df: DataFrame, order: list[str], out: str = "pos", n_ranges: int | None = None) -> DataFrame:
    """Each row's place (from 0) in the order of ``order`` (the first of them a number).

    Ranges of the first key come from approximate percentiles of that column, as
    many as the rows ask for; counts of ranges are summed up, and ranks inside a
    range added. A value of the first key that very many rows share is the lower
    end of its range; its rows are cut into ranges of the second key, if that is
    a number. Beyond MOST_RANGES * RANGE_ROWS rows, ranges grow.
    """
    n = df.count()
    n_ranges = n_ranges or min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    shares = lambda k: F.array(*(F.lit(i / k) for i in range(1, k)))
    bounds = sorted(set(df.agg(F.percentile_approx(order[0], shares(n_ranges), F.lit(10 * n_ranges)).alias("b")).first()["b"] or []))
    edges = _cuts(bounds)
    d = df.withColumn("_pos_g", F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col(order[0]))), F.lit(0)) if bounds else F.lit(0)).withColumn("_pos_h", F.lit(0))
    heavy = [r["_pos_g"] for r in d.groupBy("_pos_g").agg(F.count("*").alias("n")).where(F.col("n") > 4 * max(RANGE_ROWS, n // n_ranges)).collect() if r["_pos_g"]]  # n_ranges rows at most
    if heavy and len(order) > 1 and dict(df.dtypes)[order[1]] in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        at_edge = F.col("_pos_g").isin(heavy) & (F.col(order[0]) == F.try_element_at(edges, F.col("_pos_g")))
        inner = d.where(at_edge).groupBy("_pos_g").agg(F.percentile_approx(order[1], shares(LEAST_RANGES), F.lit(10 * LEAST_RANGES)).alias("b")).collect()
        for r in inner:
            place = F.coalesce(F.size(F.filter(_cuts(r["b"]), lambda b: b <= F.col(order[1]))), F.lit(0))
            d = d.withColumn("_pos_h", F.when(F.col("_pos_g") == r["_pos_g"], F.when(at_edge, place).otherwise(LEAST_RANGES + 1)).otherwise(F.col("_pos_h")))
    counts = d.groupBy("_pos_g", "_pos_h").agg(F.count("*").alias("_pos_c"))
    base = counts.select("_pos_g", "_pos_h", F.coalesce(F.sum("_pos_c").over(Window.orderBy("_pos_g", "_pos_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_pos_base"))
    d = d.withColumn("_pos_r", F.row_number().over(Window.partitionBy("_pos_g", "_pos_h").orderBy(*order)) - 1)
    return d.join(F.broadcast(base), ["_pos_g", "_pos_h"]).withColumn(out, F.col("_pos_base") + F.col("_pos_r")).drop("_pos_g", "_pos_h", "_pos_r", "_pos_base")  # a row for each range


def position_in_group(df: DataFrame, group: list[str], order: list[str], out: str = "pos", n_ranges: int = LEAST_RANGES) -> DataFrame:
    """Each row's place (from 0) in its group; a group that holds most rows is spread over ranges of the first key of ``order``, a number."""
    bounds = df.agg(F.percentile_approx(order[0], F.array(*(F.lit(i / n_ranges) for i in range(1, n_ranges))), F.lit(10 * n_ranges)).alias("b")).first()["b"]
    d = df.withColumn("_g", F.coalesce(F.size(F.filter(_cuts(bounds), lambda b: b <= F.col(order[0]))), F.lit(0)) if bounds else F.lit(0))
    before = Window.partitionBy(*(f"_k{i}" for i in range(len(group)))).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*(F.col(g).alias(f"_k{i}") for i, g in enumerate(group)), F.col("_g").alias("_at")).agg(F.count("*").alias("_c"))  # n_ranges rows a group
    base = counts.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_g").orderBy(*order)) - 1)
    on = [F.col(g).eqNullSafe(F.col(f"_k{i}")) for i, g in enumerate(group)] + [F.col("_g") == F.col("_at")]
    return d.join(base, on).withColumn(out, F.col("_base") + F.col("_r")).select(*df.columns, out)


def shuffled_key(seed: int, *cols: str) -> Column:
    """A deterministic shuffle's sort key: a digest of seed and id."""
    return F.md5(F.concat_ws(":", F.lit(seed), *cols))


def numbered_key(seed: int, *cols: str) -> Column:
    """The first 52 bits of :func:`shuffled_key`, as a number that percentiles can cut."""
    return F.conv(F.substring(shuffled_key(seed, *cols), 1, 13), 16, 10).cast("long")


def concat(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def interleave(parts: DataFrame, dataset: str, row: str, n: int, stop: str = "first") -> DataFrame:
    """Rows of datasets 0 .. n-1 in turn. ``first`` ends with the first that runs out (a round may be begun), ``all`` starts used-up ones anew until the largest is done, ``once`` leaves used-up ones out.

    ``parts`` has a dataset number and a row number (from 0) in it.
    """
    sizes = {r[dataset]: r["n"] for r in parts.groupBy(dataset).agg(F.count("*").alias("n")).collect()}  # n rows
    place = F.struct(F.col("_round"), F.col(dataset))
    if stop == "once":
        d = parts.withColumn("_round", F.col(row))
    elif stop == "first":
        short = min(sizes.get(i, 0) for i in range(n))
        ends = min(i for i in range(n) if sizes.get(i, 0) == short)
        d = parts.withColumn("_round", F.col(row)).where((F.col("_round") < short) | ((F.col("_round") == short) & (F.col(dataset) < ends)))
    else:
        most = max(sizes.values())
        size = F.element_at(F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, v))), F.col(dataset))
        turns = F.sequence(F.lit(0), F.ceil(F.lit(most) / size).cast("int"))
        d = parts.withColumn("_turn", F.explode(turns)).withColumn("_round", F.col(row) + F.col("_turn") * size).where(F.col("_round") < most).drop("_turn")
    return d.withColumn("place", place).drop("_round")


def blend_index(weights: list[float], size: int) -> list[tuple[int, int]]:
    """Dataset and sample number of each of ``size`` draws: always the dataset that is furthest behind its weight. Driver-side: an index, not rows."""
    counts, out = [0] * len(weights), []
    for t in range(size):
        behind = [w * max(t, 1.0) - c for w, c in zip(weights, counts, strict=True)]
        k = max(range(len(weights)), key=lambda i: (behind[i], -i))
        out.append((k, counts[k]))
        counts[k] += 1
    return out


def exhaustive_blend_index(sizes: list[int]) -> list[tuple[int, int]]:
    """As :func:`blend_index` with weights in proportion to ``sizes``, each dataset left out once it is used up."""
    total = sum(sizes)
    counts, out = [0] * len(sizes), []
    for t in range(total):
        live = [i for i, s in enumerate(sizes) if counts[i] < s]
        k = max(live, key=lambda i: (sizes[i] / total * max(t, 1.0) - counts[i], -i))
        out.append((k, counts[k]))
        counts[k] += 1
    return out


def paced(parts: DataFrame, row: str, weight: str) -> DataFrame:
    """The blend of many rows without an index: rows ordered by when a dataset of this weight reaches them."""
    return parts.withColumn("pace", (F.col(row) + 0.5) / F.col(weight))


def blend_sizes(weights: list[float], target: int, surplus: float = 0.0) -> list[int]:
    total = sum(weights)
    return [math.ceil(math.ceil(target * w / total) * (1 + surplus)) for w in weights]


def split_bounds(split: str | list[float]) -> list[tuple[float, float] | None]:
    """'99,1,0' as intervals of the unit line, None for an empty one."""
    parts = [float(x) for x in split.split(",")] if isinstance(split, str) else list(split)
    parts = (parts + [0.0] * 3)[: max(3, len(parts))]
    total, out, at = sum(parts), [], 0.0
    for p in parts:
        to = at + p / total
        out.append((at, to) if p > 0 else None)
        at = to
    return out


def exact_split(df: DataFrame, seed: int, shares: list[float], *ids: str) -> DataFrame:
    """``split``: the number of the part each row falls to; parts have exactly floor(n * cumulative share) rows before them."""
    d = with_position(df.withColumn("_k", numbered_key(seed, *ids)), ["_k", *ids], "_p")
    n = df.count()
    cuts = [int(n * sum(shares[: i + 1])) for i in range(len(shares) - 1)]
    part = F.lit(0)
    for i, c in enumerate(cuts):
        part = F.when(F.col("_p") >= c, i + 1).otherwise(part)
    return d.withColumn("split", part).drop("_k", "_p")


def repeat(df: DataFrame, times: int, order: str, interleaved: bool = True) -> DataFrame:
    """``times`` copies of each row; ``place`` orders them side by side or one table after the other."""
    d = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return d.withColumn("place", F.struct(order, "copy") if interleaved else F.struct("copy", order))


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own ``times`` says; 0 drops it."""
    return df.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times).cast("int") - 1)))


def unfold(df: DataFrame, columns: list[str], parts: int) -> DataFrame:
    """List columns cut into ``parts`` equal pieces, a row each; other columns repeat."""
    d = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        size = (F.size(c) / parts).cast("int")
        d = d.withColumn(c, F.slice(c, F.col("part") * size + 1, size))
    return d


def pad_to_divisor(df: DataFrame, order: list[str], divisor: int) -> DataFrame:
    """Leading rows repeated until the count divides; copies are marked ``is_pad``."""
    missing = -df.count() % divisor
    out = df.withColumn("is_pad", F.lit(False))
    return out if not missing else out.unionAll(df.orderBy(*order).limit(missing).withColumn("is_pad", F.lit(True)))


def partition_bounds(n: int, parts: int) -> list[tuple[int, int]]:
    """Evenly spaced bounds, cut down to whole numbers."""
    cuts = [int(x) for x in np.linspace(0, n, parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def chunk(df: DataFrame, order: list[str], size: int) -> DataFrame:
    return with_position(df, order, "_p").withColumn("chunk", F.floor(F.col("_p") / size)).drop("_p")


# ------------------------------------------------------------------ packing


def knapsack(numbers: list[int], capacity: int) -> list[list[int]]:
    """Bins filled greedily, each time with the largest number that still fits; a number above the capacity is an error."""
    rest = sorted(numbers)
    if rest and rest[-1] > capacity:
        raise ValueError(f"{rest[-1]} exceeds the capacity {capacity}")
    out = []
    while rest:
        room, bin_ = capacity, []
        while (i := bisect.bisect_right(rest, room)) and rest:
            room -= rest[i - 1]
            bin_.append(rest.pop(i - 1))
        out.append(bin_)
    return out


def pack(df: DataFrame, batch: str, key: str, length: str, capacity: int) -> DataFrame:
    """``batch``, pack number and place in it of each row: greedy packing inside each batch (a bounded group of rows). Rows above the capacity get none."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[length] <= capacity].sort_values([length, key])
        waiting: dict[int, list] = {}
        for k, n in zip(pdf[key], pdf[length], strict=True):
            waiting.setdefault(int(n), []).append(k)
        rows = [(waiting[n].pop(0), p, i) for p, bin_ in enumerate(knapsack([int(x) for x in pdf[length]], capacity)) for i, n in enumerate(bin_)]
        out = pd.DataFrame(rows, columns=[key, "pack", "place"])
        out.insert(0, batch, pdf[batch].iloc[0] if len(pdf) else 0)
        return out

    kinds = dict(df.dtypes)
    return df.select(batch, key, length).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {key} {kinds[key]}, pack long, place long")


def balanced_partitions(lengths: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Positions dealt into ``k`` parts of nearly equal sums by largest differencing; ``equal_size`` asks for equal counts."""
    if len(lengths) < k or (equal_size and len(lengths) % k):
        raise ValueError("too few lengths, or not a multiple of the parts")
    order = sorted(range(len(lengths)), key=lambda i: lengths[i])
    groups = [order[i : i + k] for i in range(0, len(order), k)] if equal_size else [[i] for i in order]
    heap: list = []
    for n, g in enumerate(groups):
        parts = sorted(((lengths[i], [i]) for i in g), key=lambda p: -p[0])
        parts += [(0, [])] * (k - len(parts))
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), n, parts))
    made = len(groups)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        parts = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: -p[0])
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), made, parts))
        made += 1
    return [sorted(p[1]) for p in heap[0][2]]


def lightest_bin(lengths: list[int], k: int) -> list[list[int]]:
    """Positions dealt in the order given, each to the part of least sum."""
    out, sums = [[] for _ in range(k)], [0] * k
    for i, n in enumerate(lengths):
        j = min(range(k), key=lambda j: sums[j])
        out[j].append(i)
        sums[j] += n
    return out


def micro_batches(df: DataFrame, batch: str, key: str, length: str, most: int) -> DataFrame:
    """``micro``: the micro-batch of each row of a batch; as many as the tokens need, balanced by an estimate of their cost."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        n = [int(x) for x in pdf[length]]
        k = max(1, min(len(n), -(-sum(n) // most)))
        micro = {i: m for m, part in enumerate(balanced_partitions([24576 * x + x * x for x in n], k)) for i in part}
        return pdf[[batch, key]].assign(micro=[micro[i] for i in range(len(n))])

    kinds = dict(df.dtypes)
    return df.select(batch, key, length).groupBy(batch).applyInPandas(one, f"{batch} {kinds[batch]}, {key} {kinds[key]}, micro long")


# ------------------------------------------------------------------ token streams


def offsets(docs: DataFrame, order: list[str], length: str) -> DataFrame:
    """``start``: tokens of all documents before each one, in two levels."""
    d = with_position(docs, order, "_p").withColumn("_g", F.floor(F.col("_p") / 4096))
    sums = d.groupBy("_g").agg(F.sum(length).alias("_s"))
    base = sums.select("_g", F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    run = F.coalesce(F.sum(length).over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_run", run).join(base, "_g").withColumn("start", F.col("_base") + F.col("_run")).drop("_g", "_p", "_run", "_base")


def sample_index(docs: DataFrame, order: list[str], length: str, sequence: int) -> DataFrame:
    """sample, document and offset at which each sample of ``sequence`` tokens begins (samples share their last token with the next): an explode of each document's own samples, no range join."""
    d = offsets(docs, order, length).where(F.col(length) > 0)
    first = F.ceil(F.col("start") / sequence)
    last = F.floor((F.col("start") + F.col(length) - 1) / sequence)
    d = d.where(first <= last).withColumn("sample", F.explode(F.sequence(first, last)))
    return d.withColumn("offset", F.col("sample") * sequence - F.col("start"))


def chunks(docs: DataFrame, length: str, size: int) -> DataFrame:
    """start and stop of the windows of ``size`` of each document, the last one shorter; empty documents have none."""
    d = docs.where(F.col(length) > 0).withColumn("begin", F.explode(F.sequence(F.lit(0), F.col(length).cast("int") - 1, F.lit(size))))
    return d.withColumn("stop", F.least(F.col("begin") + size, F.col(length).cast("int")))

