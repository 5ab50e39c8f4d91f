"""What the training-data operators share: session helpers and byte-level text kernels.

The kernels work on the flat UTF-8 buffer of an Arrow string column, so that a
batch of texts is handled by a fixed number of numpy passes instead of a Python
loop over words. Every pass sees at most ``SLICE_BYTES`` of text (or a single
text, if that is longer), which bounds a worker's memory whatever Spark's batch
size is.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.storage import materialize, release, shared_dir, sized  # noqa: F401  shared by the operators

SLICE_BYTES = 512 << 10
#: Bytes of a batch that the JVM hands to a Python worker, or one row; by default 10,000 rows go at once, whole texts among them.
BATCH_BYTES = 4 << 20
#: The six ASCII white-space bytes that the word contracts exclude.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])


# ---------------------------------------------------------------- session


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where only the driver's path knows it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


def small_batches(spark: SparkSession) -> SparkSession:
    """Hand texts to Python workers in batches of ``BATCH_BYTES``, as both sides hold a batch whole. It holds for the session, as results are lazy; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; then the worker, which waits for its next task, gives back to the system what this one freed."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim is not None:
            trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    held = {c.lower() for c in df.columns}
    return [next(x for x in (name + "_" * k for k in range(len(held) + 1)) if x.lower() not in held) for name in names]


# ---------------------------------------------------------------- native prefix sums


def prefix_sums(df: DataFrame, group: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``group``, in order of (``bucket``, ``order``).

    Two levels: windows inside each (group, bucket), and a window over the
    bucket totals, so that no group, however hot, meets in one task. ``bucket``
    must be monotone in the order. The bucket totals are computed from the same
    rows and joined back.
    """
    from pyspark.sql import Window

    keys = [*group, bucket]
    tot = df.groupBy(*keys).agg(F.sum(value).alias("_tot"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = before.partitionBy(*group) if group else before
    base = tot.select(*[F.col(k).alias(f"_b_{k}") for k in keys], F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_run", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    return df.join(base, on, "left").withColumn(out, F.col("_base") + F.col("_run")).drop("_run", "_base", *[f"_b_{k}" for k in keys])


# ---------------------------------------------------------------- flat text


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a string or binary column; nulls count as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts hold ``most`` bytes, or one row each."""
    at, n = 0, batch.num_rows
    if not n:
        return
    _, offsets = flat(batch.column(batch.schema.get_field_index(text)))
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at)
        at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    table_ = np.arange(256, dtype=np.uint8)
    table_[65:91] += 32
    return table_[data]


def _is_delimiter(delimiters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(delimiters)] = True
    return out


def spans(data: np.ndarray, offsets: np.ndarray, delimiters: bytes = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside ``delimiters``; runs end with their text."""
    inside = ~_is_delimiter(delimiters)[data]
    if not inside.any():
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.empty(len(data) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # texts that touch without white space between
    at = np.flatnonzero(edge)
    if len(cuts):
        at = np.sort(np.concatenate([at, cuts, cuts]), kind="stable")
    starts, ends = at[0::2], at[1::2]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


_P = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)]
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
_INVERSE: list[np.ndarray] = [np.ones(1, np.uint64)] * 2
#: 64 random bits for each byte value, from a fixed seed.
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 64, (2, 256), np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[k]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for held, base in ((_POWERS, _P[k]), (_INVERSE, np.uint64(pow(int(_P[k]), -1, 1 << 64)))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            held[k] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[k], _INVERSE[k]


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """Two polynomial hashes of each span, over random byte values."""
    for k in (0, 1):
        power, inverse = _power(k, len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[k][data] * power[: len(data)], out=prefix[1:], dtype=np.uint64)
        yield (prefix[ends] - prefix[starts]) * inverse[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: two polynomial hashes, mixed with the length."""
    out = mix((ends - starts).astype(np.uint64) + np.uint64(0x51ED270B))
    for x in _polynomials(data, starts, ends):
        out = mix(out ^ x)
    return out


def span_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each span, as two halves; the first is never 0."""
    size = mix((ends - starts).astype(np.uint64) + np.uint64(0x51ED270B))
    a, b = _polynomials(data, starts, ends)
    return np.maximum(mix(a ^ size), np.uint64(1)), mix(b ^ size)


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    """n+1 offsets of the items of each row; ``rows`` ascends."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's ``n``-word shingles (fewer words: the whole sequence as one) and their offsets, repeats kept.

    ``counts`` are the offsets of each row's words in ``hashes``. Rows without
    words have no shingle.
    """
    words = np.diff(counts)
    made = np.where(words >= n, words - n + 1, np.minimum(words, 1))
    offsets = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    first = np.repeat(counts[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    end = np.minimum(first + n, np.repeat(counts[1:], made))
    out = np.full(len(first), 0x2545F4914F6CDD1D, np.uint64)
    for i in range(n):
        at = first + i
        there = at < end
        out[there] = mix(out[there] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[there]])
    return out, offsets


def unique_in_rows(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending, and their offsets."""
    v, at = values.copy(), offsets.tolist()
    for a, b in zip(at[:-1], at[1:], strict=True):  # a loop over texts; sorting all rows at once takes longer
        v[a:b].sort()
    keep = np.ones(len(v), bool)
    keep[1:] = v[1:] != v[:-1]
    keep[offsets[:-1][offsets[:-1] < len(v)]] = True
    return v[keep], np.concatenate([[0], np.cumsum(keep)])[offsets].astype(np.int64)


def gather(data: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked items of a ragged array, one after the other, and their offsets."""
    sizes = offsets[pick + 1] - offsets[pick]
    out = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    at = np.repeat(offsets[pick] - out[:-1], sizes) + np.arange(out[-1])
    return data[at], out


class WordCache:
    """Ids of words seen so far, as one ragged array.

    ``encode_many`` turns a list of distinct words into (flat ids, offsets).
    The first ``limit`` words stay; later ones are encoded for the call at hand
    and dropped after it, so memory is bounded and frequent words, which come
    early, are encoded once.
    """

    def __init__(self, encode_many, limit: int = 400_000) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.index: dict = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.offsets = np.zeros(1 << 12, np.int64)

    def lookup(self, words: list) -> np.ndarray:
        """The index of each word in ``ids`` and ``offsets``, good until the next call."""
        distinct = set(words)
        new = list(distinct.difference(self.index))
        if new:
            ids, offsets = self.encode_many(new)
            n = len(self.index)
            end = int(self.offsets[n])
            while len(self.ids) < end + len(ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while len(self.offsets) < n + len(new) + 1:
                self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
            self.ids[end : end + len(ids)] = ids
            self.offsets[n + 1 : n + len(new) + 1] = end + offsets[1:]
            self.index.update(zip(new, range(n, n + len(new)), strict=True))
        out = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        over = len(self.index) - self.limit
        for w in new[len(new) - over :] if over > 0 else ():
            del self.index[w]
        return out


class SpanCache:
    """Ids of spans of text seen so far, by a 128-bit hash of their bytes, without a Python object for each span.

    ``encode_many`` turns a list of byte strings into (flat ids, offsets). The
    first ``limit`` spans stay in an open-addressed table; later ones, and those
    of more than ``LONGEST`` bytes, for which the hash isn't made, are encoded for
    the call at hand. So memory is bounded and frequent spans, which come early,
    are encoded once.
    """

    LONGEST = 64

    def __init__(self, encode_many, limit: int = 1_000_000) -> None:
        self.encode_many, self.limit = encode_many, limit
        self.bits = max(4, (2 * limit).bit_length())
        self.keys, self.other = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64)
        self.place = np.zeros(1 << self.bits, np.int32)
        self.held = 0
        self.ids, self.offsets = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def _probe(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each name, or -1."""
        out = np.full(len(a), -1, np.int64)
        at = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            there = self.keys[at]
            hit = (there == a[todo]) & (self.other[at] == b[todo])
            out[todo[hit]] = self.place[at[hit]]
            on = ~hit & (there != 0)
            todo, at = todo[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def _keep(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> None:
        at = (a >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(a))
        while len(todo):
            _, firsts = np.unique(at[todo], return_index=True)
            firsts = firsts[self.keys[at[todo[firsts]]] == 0]
            put = todo[firsts]
            self.keys[at[put]], self.other[at[put]], self.place[at[put]] = a[put], b[put], place[put]
            todo = np.delete(todo, firsts)
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each span's ids in ``ids`` and ``offsets``, good until the next call."""
        short = np.flatnonzero(ends - starts <= self.LONGEST)
        a, b = span_names(data, starts[short], ends[short])
        out = np.full(len(starts), -1, np.int64)
        out[short] = self._probe(a, b)
        new = np.flatnonzero(out[short] < 0)
        _, first, name = np.unique(a[new], return_index=True, return_inverse=True)
        same = b[new] == b[new[first]][name]
        # spans whose names agree in the first half alone, and long ones, have an entry each
        single = np.concatenate([short[new[~same]], np.flatnonzero(ends - starts > self.LONGEST)])
        told = np.concatenate([short[new[first]], single])
        if not len(told):
            return out
        raw = data.tobytes()
        ids, offsets = self.encode_many([raw[x:y] for x, y in zip(starts[told].tolist(), ends[told].tolist(), strict=True)])
        n = self.held
        end = int(self.offsets[n])
        while len(self.ids) < end + len(ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while len(self.offsets) < n + len(told) + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.ids[end : end + len(ids)] = ids
        self.offsets[n + 1 : n + len(told) + 1] = end + offsets[1:]
        out[short[new]] = n + name
        out[single] = n + len(first) + np.arange(len(single))
        kept = min(len(first), self.limit - n)
        if kept > 0:
            self._keep(a[new[first[:kept]]], b[new[first[:kept]]], n + np.arange(kept))
            self.held += kept
        return out
