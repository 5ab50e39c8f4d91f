"""Exact top-k search in Hamming space by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments. A step looks up, in one segment,
the values at exactly one distance (radius) from the query's. Radii grow segment
by segment: once they are r_1 .. r_m, a code that wasn't met differs in r_i + 1
bits of each segment, so every code at distance r_1 + .. + r_m + m - 1 or less
has been seen. A query is done when its k-th verified distance is no larger.

Equal codes are one entry of the index (and equal queries one query), with the k
+ 1 smallest ids: with ties by id no other of its ids can be among the nearest.

The index of a segment lies in blocks of some BLOCK codes, by the leading bits of
the segment's value (and a hash, where many codes share these). A query goes to
the blocks whose leading bits differ from its own in no more bits than the
radius: a row for each block, however many values there are to look up. Inside a
block the remaining bits are searched in numpy: the values at the remaining
distance are listed and looked up among the block's sorted values, or, if the
block has fewer, all of these are compared. Codes met are verified there, and
each query's k + 1 best of them go back.

A Spark job takes as many steps as all jobs before it looked up values, so there
are few jobs (each writes its state to the shared folder) and a query is searched
no further than about twice as far as it needs. Nothing but counts reaches the
driver.

Defined results: rows without a vector or id are neither queries nor answers;
an element above 0 sets its bit (null and NaN elements don't); a query is no
answer to itself, but another row of equal id and code isn't told apart from
it; ties go to the smaller id; with fewer than k other rows all are returned; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import common as C

#: Codes in a block of a segment's index, and queries that meet it in one task.
BLOCK = 1 << 16
CHUNK = 1 << 16
#: Values that the first job looks up for each query, and pairs of a query and a value that are worked on at once.
FIRST_JOB, PAIRS = 1024, 1 << 19
#: Codes are lists of 32-bit words held in longs.
WORD = 32


def sign_code(vector: Column, bits: int) -> Column:
    """The code of a vector: bit i is set where element i is above 0; array<long> of 32-bit words."""
    words = []
    for w in range(0, bits, WORD):
        total = F.lit(0).cast("long")
        for i in range(w, min(bits, w + WORD)):
            v = F.get(vector, F.lit(i))
            total = total + F.when((v > 0) & ~F.isnan(v), 1 << (i - w)).otherwise(0)
        words.append(total.cast("long"))
    return F.array(*words)


def _segments(bits: int, m: int) -> list[tuple[int, int]]:
    """Start and width of each of ``m`` segments."""
    cuts = [i * bits // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _segment(code: Column, start: int, width: int) -> Column:
    """The bits of a code from ``start`` on, as a number; ``width`` is 32 at most."""
    at, shift = start // WORD + 1, start % WORD
    value = F.shiftright(F.element_at(code, at), shift)
    if shift + width > WORD:
        value = value.bitwiseOR(F.shiftleft(F.element_at(code, at + 1), WORD - shift))
    return value.bitwiseAND(F.lit((1 << width) - 1))


@lru_cache(maxsize=64)
def _masks(width: int, radius: int) -> np.ndarray:
    """All numbers of ``radius`` bits among ``width``."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _steps(parts: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The steps (segment, radius) of each job."""
    jobs, done, now, cost = [], 0, [], 0
    for radius in range(max(w for _, w in parts) + 1):
        for seg, (_, width) in enumerate(parts):
            if radius > width:
                continue
            now.append((seg, radius))
            cost += math.comb(width, radius)
            if cost >= max(FIRST_JOB, done):
                jobs.append(now)
                done, now, cost = done + cost, [], 0
    return jobs + [now] if now else jobs


def _least_ids(coded: DataFrame, k: int) -> DataFrame:
    """code and its ``k`` smallest ids; in two steps, so that a very common code is spread first."""
    spread = Window.partitionBy("code", "_salt").orderBy("vec_id")
    first = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("_r", F.row_number().over(spread)).where(F.col("_r") <= k)
    whole = Window.partitionBy("code").orderBy("vec_id")
    least = first.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= k)
    return least.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, bits: int = 64, n_segments: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and distance of the ``k`` nearest rows of each query row; ``is_query`` is a condition on ``vec_id``."""
    coded = vectors.select(vectors[id_col].cast("long").alias("vec_id"), sign_code(vectors[vector_col], bits).alias("code"), vectors[vector_col].isNull().alias("_none")).where("vec_id is not null and not _none").drop("_none")
    coded = C.materialize(coded.distinct(), "hamming-codes")
    entries = C.materialize(_least_ids(coded, k + 1), "hamming-entries")
    n = entries.count()
    # segments of about log2(n) bits: a value then belongs to a code or so
    parts = _segments(bits, n_segments or max(-(-bits // WORD), round(bits / math.log2(max(n, 16)))))
    lead = max(0, math.ceil(math.log2(max(n, 1) / BLOCK)))
    own = [_segment(F.col("code"), a, w).cast("long") for a, w in parts]
    values = F.array(*(F.struct(F.lit(i).alias("seg"), v.alias("value"), F.shiftright(v, max(0, w - lead)).alias("head")) for i, (v, (_, w)) in enumerate(zip(own, parts, strict=True))))
    index = entries.select("code", "ids", F.explode(values).alias("v")).select("code", "ids", "v.*")
    heads = index.groupBy("seg", "head").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("pieces"))
    heads = C.materialize(heads, "hamming-heads")
    index = index.join(heads, ["seg", "head"]).withColumn("piece", F.pmod(F.xxhash64("code"), F.col("pieces")).cast("int"))
    index = C.materialize(index.select("seg", "head", "piece", "value", "code", "ids"), "hamming-index")
    queries = coded.where(is_query).select("code").distinct()
    state = C.materialize(queries.select(F.col("code").alias("query"), F.array().cast("array<struct<d: int, id: long>>").alias("best")), "hamming-state")
    done: list[DataFrame] = []
    reach, jobs = [-1] * len(parts), _steps(parts)
    for job in jobs:
        last, state = state, C.materialize(_search(state, index, heads, parts, lead, job, k + 1), "hamming-state")
        C.release(last)
        for seg, radius in job:
            reach[seg] = radius
        covered = sum(reach) + len(parts) - 1
        ready = F.coalesce((F.size("best") > k) & (F.try_element_at("best", F.lit(k + 1))["d"] <= covered), F.lit(False))
        if job is jobs[-1] or state.where(~ready).isEmpty():
            done.append(state)
            break
        done.append(C.materialize(state.where(ready), "hamming-done"))
        last, state = state, C.materialize(state.where(~ready), "hamming-state")
        C.release(last)
    C.release(index, heads, entries)
    found = done[0]
    for d in done[1:]:
        found = found.unionAll(d)
    asked = coded.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
    near = asked.join(found, "query").select("query_id", F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k).alias("best"))
    return near.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b")["id"].alias("vec_id"), F.col("b")["d"].alias("distance"))


def _search(state: DataFrame, index: DataFrame, heads: DataFrame, parts: list[tuple[int, int]], lead: int, job: list[tuple[int, int]], keep: int) -> DataFrame:
    """``state`` after the steps of a job."""
    limit = F.coalesce(F.try_element_at("best", F.lit(keep))["d"], F.lit(1 << 30)).alias("limit")
    asked = None
    for seg, radius in job:
        start, width = parts[seg]
        low = max(0, width - lead)
        flips = np.concatenate([_masks(width - low, t) for t in range(min(radius, width - low) + 1) if radius - t <= low]).tolist()
        value = _segment(F.col("query"), start, width).cast("long")
        # one literal: a tree of as many literals would weigh on the driver
        flips = F.split(F.lit(",".join(map(str, flips))), ",").cast("array<bigint>")
        head = F.explode(F.transform(flips, lambda x: F.shiftright(value, low).bitwiseXOR(x)))  # noqa: B023
        rows = state.select("query", limit, F.lit(seg).alias("seg"), F.lit(radius).alias("radius"), value.alias("value"), head.alias("head"))
        asked = rows if asked is None else asked.unionAll(rows)
    asked = asked.join(heads, ["seg", "head"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = C.materialize(asked.groupBy("seg", "head", "piece").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "hamming-met")
    chunk = F.pmod(F.xxhash64("query", "radius"), F.col("chunks")).cast("int")
    asked = asked.join(met, ["seg", "head", "piece"]).withColumn("chunk", chunk)
    held = index.join(met, ["seg", "head", "piece"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cols = [F.xxhash64("seg", "head", "piece", "chunk").alias("block"), "seg"]
    none = F.lit(None)
    rows = held.select(*cols, "value", "code", "ids", none.cast("int").alias("radius"), none.cast("int").alias("limit")).unionAll(asked.select(*cols, "value", F.col("query").alias("code"), none.cast("array<bigint>").alias("ids"), "radius", "limit"))
    widths = [(w, max(0, w - lead)) for _, w in parts]
    dealt = rows.repartition("block").sortWithinPartitions("block", F.col("radius").asc_nulls_first())
    seen = dealt.mapInArrow(lambda it: _blocks(it, widths, keep), "query array<bigint>, d int, id long")
    x = F.struct("d", "id").alias("x")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("x"))
    best = seen.select("query", x).distinct().withColumn("r", rank).where(F.col("r") <= keep).groupBy("query").agg(F.collect_list("x").alias("new"))
    merged = F.slice(F.array_sort(F.array_distinct(F.concat("best", F.coalesce("new", F.array().cast("array<struct<d: int, id: long>>"))))), 1, keep)
    return state.join(best, "query", "left").select("query", merged.alias("best"))


# ------------------------------------------------------------------ inside a block


def _blocks(batches: Iterator[pa.RecordBatch], widths: list[tuple[int, int]], keep: int) -> Iterator[pa.RecordBatch]:
    """Blocks one after the other, each with its index rows first and then its queries."""
    now, held, block = None, [], None
    for batch in batches:
        key = C.column(batch, "block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            if now != key[a]:
                now, held, block = key[a], [], None
            entries = C.column(part, "radius").null_count
            if entries:
                held.append(part.slice(0, entries))
            if entries < part.num_rows:
                if block is None:
                    block, held = _Block(pa.Table.from_batches(held).combine_chunks(), keep), []
                yield from block.search(part.slice(entries), *widths[C.column(part, "seg")[0].as_py()])


def _words(codes: pa.Array) -> np.ndarray:
    flat = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    return flat.flatten().to_numpy().reshape(len(flat), -1)


class _Block:
    """Codes of a block in the order of their segment's value."""

    def __init__(self, rows: pa.Table, keep: int) -> None:
        value = rows.column("value").to_numpy()
        order = np.argsort(value, kind="stable")
        self.values, self.at = np.unique(value[order], return_index=True)
        self.at = np.append(self.at, len(value))
        self.codes = _words(rows.column("code"))[order]
        ids = rows.column("ids").combine_chunks()
        sizes = ids.value_lengths().to_numpy()
        self.ids, self.ids_at = C.gather(ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), order)
        self.keep = keep

    def search(self, queries: pa.RecordBatch, width: int, low: int) -> Iterator[pa.RecordBatch]:
        """The best codes at exactly each query's radius in this segment, as rows of query, d and id."""
        value, radius, limit = (C.column(queries, c).to_numpy() for c in ("value", "radius", "limit"))
        codes = _words(C.column(queries, "code"))
        head = int(self.values[0]) >> low
        rest = radius - np.bitwise_count((value >> low) ^ head)
        best_q, best_d, best_row = [], [], []
        for r in np.unique(rest):
            mine = np.flatnonzero(rest == r)
            masks = math.comb(low, int(r)) if 0 <= r <= low else 0
            if not masks:
                continue
            listed = masks < len(self.values)
            per = max(1, PAIRS // max(1, min(masks, len(self.values))))
            for k in range(0, len(mine), per):
                q = mine[k : k + per]
                if listed:
                    wanted = (head << low) | ((value[q] & ((1 << low) - 1))[:, None] ^ _masks(low, int(r))[None, :])
                    spot = np.minimum(np.searchsorted(self.values, wanted.ravel()), len(self.values) - 1)
                    hit = np.flatnonzero(self.values[spot] == wanted.ravel())
                    who, spot = q[hit // masks], spot[hit]
                else:
                    who, spot = np.nonzero(np.bitwise_count(value[q][:, None] ^ self.values[None, :]) == radius[q][:, None])
                    who = q[who]
                row, _ = C.gather(np.arange(len(self.codes)), self.at, spot)
                who = np.repeat(who, self.at[spot + 1] - self.at[spot])
                d = np.bitwise_count(codes[who] ^ self.codes[row]).sum(1, dtype=np.int64)
                near = d <= limit[who]
                who, d, row = self._least(who[near], d[near], row[near])
                best_q.append(who)
                best_d.append(d)
                best_row.append(row)
        if not best_q:
            return
        who, d, row = self._least(np.concatenate(best_q), np.concatenate(best_d), np.concatenate(best_row))
        ids, at = C.gather(self.ids, self.ids_at, row)
        n = np.diff(at)
        who, d = np.repeat(who, n), np.repeat(d, n)
        yield pa.RecordBatch.from_arrays([C.column(queries, "code").take(pa.array(who)), pa.array(d.astype(np.int32)), pa.array(ids)], ["query", "d", "id"])

    def _least(self, who: np.ndarray, d: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each query's ``keep`` nearest codes, ties by their smallest id: others can't hold any of its nearest ids."""
        order = np.lexsort((self.ids[self.ids_at[row]], d, who))
        who, d, row = who[order], d[order], row[order]
        first = np.concatenate([[True], who[1:] != who[:-1]]) if len(who) else np.zeros(0, bool)
        nth = np.arange(len(who)) - np.maximum.accumulate(np.where(first, np.arange(len(who)), 0))
        few = nth < self.keep
        return who[few], d[few], row[few]
