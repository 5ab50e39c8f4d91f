"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text becomes a sequence of units, and its k-mers are the runs of ``k`` units. A
run without white space is a unit; one of more than ``UNIT_BYTES`` bytes gives
overlapping units instead, ``UNIT_BYTES`` bytes from each of its characters on,
until one reaches its end. So an edit changes the units that it touches alone,
with or without white space around them. Each k-mer is numbered by its occurrence in the text, so that repeats count. For each
of ``m`` hash functions, the ``l`` occurrence-numbered k-mers of least hash are
selected, put back into the order of the text, and the tuple is hashed: one
sketch. Equal sketches in two fingerprints mean that the same k-mers were
selected *in the same order*, so shuffled contents don't look alike. The likeness
of two fingerprints is the share of equal sketches.

A fingerprint is the ``m`` sketches as 8 hexadecimal digits each.

Neighbours in id order are found without a global sort in one task: rows are
dealt by ranges of the id (bounds from the id column alone), sorted in them,
and the first row of each range goes to the range before it too, as its last
neighbour. Ids alone come to the driver, one for each range, and no text does.

Defined results: null and empty texts (and texts of white space alone) have the
fingerprint of the empty sequence and likeness 1 to each other; texts of fewer
than k units have one k-mer, the whole sequence; with fewer than ``l`` k-mers all
are selected; null ids come first; rows of equal id are ordered by text; the
only row of a table is its own neighbour; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import common as C

UNIT_BYTES = 16
M, L, K = 64, 2, 2
EMPTY = 0x6F6D6831
_RNG = np.random.Generator(np.random.PCG64(4242))
_MULTIPLIERS = _RNG.integers(1 << 62, 1 << 63, 256, np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 63, 256, np.uint64)
#: Places in a text take the low bits of a key, hash values the others. In texts
#: of more k-mers the low bits are empty, and the first of equal keys is the least.
PLACE_BITS = 24


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the units of each text and their offsets."""
    starts, ends, rows = C.spans(data, offsets)
    long = ends - starts > UNIT_BYTES
    if long.any():
        places = np.where(long, ends - starts, 1)
        at = np.arange(places.sum()) + np.repeat(starts - np.cumsum(places) + places, places)
        head = (data[at] & 0xC0) != 0x80
        first = np.zeros(len(at), bool)
        first[np.cumsum(places) - places] = True
        head |= first
        at, first = at[head], first[head]
        ends, rows = np.repeat(ends, places)[head], np.repeat(rows, places)[head]
        # a unit is made where the one before has not reached the end of the run
        first[1:] |= at[:-1] + UNIT_BYTES < ends[1:]
        starts, ends, rows = at[first], np.minimum(at + UNIT_BYTES, ends)[first], rows[first]
    return C.span_hashes(data, starts, ends), C.row_counts(rows, len(offsets) - 1)


def numbered(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each value hashed with its occurrence number in its row."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    out = np.empty_like(values)
    out[order] = C.mix(v + C.mix((np.arange(len(v)) - begin).astype(np.uint64)))
    return out


def sketches(data: np.ndarray, offsets: np.ndarray, m: int = M, l: int = L, k: int = K) -> np.ndarray:  # noqa: E741
    """The fingerprint of each text as a row of ``m`` 32-bit sketches."""
    n = len(offsets) - 1
    kmers, at = C.shingles(*units(data, offsets), k)
    size = np.diff(at)
    out = np.full((n, m), EMPTY, np.uint32)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    x = numbered(kmers, at)
    start = at[:-1][full]
    place = (np.arange(len(x)) - np.repeat(start, size[full])).astype(np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    huge = np.flatnonzero(size[full] >= 1 << PLACE_BITS)
    for h in huge:
        place[start[h] : start[h] + size[full[h]]] = 0
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(m):
        key = x * _MULTIPLIERS[j] + _SHIFTS[j]
        key ^= key >> np.uint64(31)
        key *= np.uint64(0x9FB21C651E98DF25)
        key &= ~low
        key |= place
        chosen = np.full((l, len(full)), most, np.uint64)
        for i in range(l):
            least = np.minimum.reduceat(key, start)
            has = least != most
            spot = least & low
            for h in huge:
                spot[h] = np.argmin(key[start[h] : start[h] + size[full[h]]])
            chosen[i, has] = spot[has]
            key[start[has] + spot[has].astype(np.int64)] = most
        chosen.sort(0)  # back into the order of the text
        mixed = np.full(len(full), 0x9E3779B97F4A7C15, np.uint64)
        for i in range(l):
            has = chosen[i] != most
            mixed[has] = C.mix(mixed[has] * np.uint64(31) + x[start[has] + chosen[i, has].astype(np.int64)])
        out[full, j] = (mixed >> np.uint64(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(1)


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.astype(">u4").tobytes().hex() for r in rows], pa.string())


def _bytes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _compare(ids: list, texts: list[str], options: dict) -> pa.RecordBatch:
    """All but the last text, each with its edited text and the next one."""
    n = len(ids) - 1
    edited = [t[: len(t) - len(t) // 2] + nxt[: len(t) // 2] for t, nxt in zip(texts[:-1], texts[1:], strict=True)]
    own = sketches(*_bytes_of(texts), **options)
    other = sketches(*_bytes_of(edited), **options)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _hex(own[:n]),
            _hex(other),
            pa.array(likeness(own[:n], other)),
            pa.array(likeness(own[:n], own[1:])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ranges(batches: Iterator[pa.RecordBatch], options: dict) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one or more ranges, each ended by the row that follows it."""
    ids: list = []
    texts: list[str] = []
    for batch in batches:
        for part in C.slices(batch, "text"):
            for tail, key, text in zip(*(C.column(part, c).to_pylist() for c in ("tail", "doc_id", "text")), strict=True):
                ids.append(key)
                texts.append(text or "")
                if tail:
                    yield _compare(ids, texts, options)
                    ids, texts = [], []
            if len(ids) > 1:
                yield _compare(ids, texts, options)
                ids, texts = ids[-1:], texts[-1:]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", m: int = M, l: int = L, k: int = K) -> DataFrame:  # noqa: E741
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The edited text has its last floor(n/2) code points replaced by the first as
    many of the next document's.
    """
    spark = C.importable(docs.sparkSession)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(i / n_ranges) for i in range(1, n_ranges)))
    found = base.agg(F.percentile_approx("doc_id", shares, F.lit(10 * n_ranges)).alias("b")).first()["b"] if n_ranges > 1 else None
    bounds = np.unique(np.array(found or [], np.int64))
    place = F.lit(0)
    if len(bounds):
        edges = F.array(*(F.lit(int(b)) for b in bounds))
        place = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(0))
    # the row that each range begins with ends the range before it (the first one the last): ids alone come to the driver, one for each range
    firsts = base.select("doc_id", place.alias("range")).groupBy("range").agg(F.min("doc_id").alias("first"), F.bool_or(F.col("doc_id").isNull()).alias("null"))
    firsts = {r["range"]: None if r["null"] else r["first"] for r in firsts.collect()}
    order = sorted(firsts)
    before = {firsts[r]: order[i - 1] for i, r in enumerate(order)}
    named = [F.lit(int(x)) for k, v in before.items() if k is not None for x in (k, v)]
    goes = F.try_element_at(F.create_map(*named), F.col("doc_id")) if named else F.lit(None).cast("int")
    if None in before:
        goes = F.when(F.col("doc_id").isNull(), before[None]).otherwise(goes)
    rows = base.select("doc_id", "text", place.cast("int").alias("range"), F.lit(False).alias("tail"))
    tails = base.select("doc_id", "text", goes.cast("int").alias("range")).where("range is not null").groupBy("doc_id", "range").agg(F.min("text").alias("text"))
    rows = rows.unionByName(tails.withColumn("tail", F.lit(True)))
    options = {"m": m, "l": l, "k": k}
    dealt = rows.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "tail", "doc_id", "text").select("tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(lambda it: _ranges(it, options), schema)
