"""Quality classifier: a second-order factorisation machine over hashed words, structure statistics and metadata.

Each text becomes a sparse vector: its distinct words, hashed into ``2 **
bits`` slots and weighted by their share, then structure statistics (shares of
upper-case, digit, symbol, pipe and exclamation bytes, mean word and line
length, repeated words and lines, ...) and metadata columns, each cut into
bins whose indicators have slots of their own. The score is

    b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]

so all pairwise interactions cost time linear in the text.

Training takes labelled rows only, those that ``sample_key`` admits, and of
these at most ``max_rows``, the ones of the smallest hash: a documented bound,
so that what reaches the driver doesn't grow with the corpus. Features are made
on the executors. Scoring maps over all rows without a shuffle.

Defined results: a null text counts as empty and gets a score like any other; a
null metadata value falls into a bin of its own; duplicate label rows for an id
count once (the larger label); ids without a text are no training rows; without
both labels among the training rows the score is the share of label 1, or 0.5
without any; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm import common as C

STATS = ("bytes", "words", "lines", "upper", "digit", "symbol", "pipe", "bang", "percent", "word_len", "line_len", "distinct_words", "distinct_lines", "longest_word", "symbol_words", "long_line", "upper_words", "short")
BINS = 12
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*|!@^~+=<>{}[]\\/_`")] = True


def _binned(x: np.ndarray, log: bool) -> np.ndarray:
    """Bins of fixed edges: powers of two for sizes, powers of 1/2 below 1 for shares."""
    if log:
        return np.clip(np.log2(np.maximum(x, 1)), 0, BINS * 2 - 1).astype(np.int64) // 2
    edges = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
    return np.clip(np.searchsorted(edges, x, "right") - 1, 0, BINS - 1)


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(data: np.ndarray, offsets: np.ndarray, meta: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots, values and row offsets of the sparse vectors of a batch of texts.

    ``meta`` has a float array for each metadata column, NaN for null.
    """
    n = len(offsets) - 1
    low = C.lower_ascii(data)
    starts, ends, rows = C.spans(low, offsets)
    hashes = C.span_hashes(low, starts, ends)
    at = C.row_counts(rows, n)
    words = np.diff(at)
    distinct, d_at = C.unique_in_rows(hashes, at)
    line_s, line_e, line_r = C.spans(data, offsets, b"\n")
    line_at = C.row_counts(line_r, n)
    lines = np.diff(line_at)
    distinct_lines = np.diff(C.unique_in_rows(C.span_hashes(data, line_s, line_e), line_at)[1])
    length = (ends - starts).astype(np.float64)
    symbol = _SYMBOL[data]
    running = np.concatenate([[0], np.cumsum(symbol)])
    upper = (data >= 65) & (data <= 90)
    up = np.concatenate([[0], np.cumsum(upper)])
    size = np.diff(offsets).astype(np.float64)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    stats = [
        (size, True), (words, True), (lines, True),
        (_share(upper, offsets), False), (_share((data >= 48) & (data <= 57), offsets), False), (_share(symbol, offsets), False),
        (_share(data == 124, offsets), False), (_share(data == 33, offsets), False), (_share(data == 37, offsets), False),
        (np.minimum(_sum(length, at) / np.maximum(words, 1) / 20, 1), False), (size / np.maximum(lines, 1), True),
        (np.diff(d_at) / np.maximum(words, 1), False), (distinct_lines / np.maximum(lines, 1), False), (longest, True),
        (_sum(running[ends] - running[starts] > 0, at) / np.maximum(words, 1), False),
        (_sum((line_e - line_s) > 2000, line_at) / np.maximum(lines, 1), False),
        (_sum((up[ends] - up[starts]) * 2 > length, at) / np.maximum(words, 1), False), (words < 5, False),
    ]
    base = 1 << bits
    dense = [base + k * BINS + _binned(np.asarray(x, np.float64), log) for k, (x, log) in enumerate(stats)]
    for k, x in enumerate(meta):
        dense.append(base + (len(stats) + k) * BINS + np.where(np.isnan(x), BINS - 1, np.minimum(_binned(np.nan_to_num(x), True), BINS - 2)))
    dense = np.stack(dense, 1)
    weight = np.repeat(1 / np.sqrt(np.maximum(np.diff(d_at), 1)), np.diff(d_at))
    out_at = d_at + np.arange(n + 1) * dense.shape[1]
    slots, values = np.empty(out_at[-1], np.int64), np.empty(out_at[-1], np.float64)
    put = (out_at[:-1, None] + np.arange(dense.shape[1])).ravel()
    rest = np.ones(out_at[-1], bool)
    rest[put] = False
    slots[put], values[put] = dense.ravel(), 1 / np.sqrt(dense.shape[1])
    slots[rest], values[rest] = (distinct >> np.uint64(64 - bits)).astype(np.int64), weight
    return slots, values, out_at


@dataclass
class FactorisationMachine:
    """Weights of a trained machine; ``prior`` stands in where nothing could be learnt."""

    bits: int
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    prior: float | None = None

    def raw(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(vx, offsets[:-1]) if len(slots) else np.zeros((0, self.factors.shape[1]))
        squares = np.add.reduceat((vx * vx).sum(1), offsets[:-1]) if len(slots) else np.zeros(0)
        first = np.add.reduceat(self.linear[slots] * values, offsets[:-1]) if len(slots) else np.zeros(0)
        return self.bias + first + 0.5 * ((sums * sums).sum(1) - squares), sums

    def score(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(offsets) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.raw(slots, values, offsets)[0], -40, 40)))


def fit(slots: np.ndarray, values: np.ndarray, offsets: np.ndarray, labels: np.ndarray, bits: int, meta: int, rank: int = 6, epochs: int = 8, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> FactorisationMachine:
    """Logistic loss by Adagrad over shuffled mini-batches, both labels weighing the same in sum up to a factor of 4."""
    n = len(offsets) - 1
    if not n or labels.min() == labels.max():
        return FactorisationMachine(bits, 0.0, np.zeros(0), np.zeros((0, rank)), float(labels.mean()) if n else 0.5)
    rng = np.random.Generator(np.random.PCG64(seed))
    size = (1 << bits) + (len(STATS) + meta) * BINS
    m = FactorisationMachine(bits, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    g_b, g_w, g_v = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    share = labels.mean()
    weight = np.where(labels == 1, 1.0, np.clip(share / (1 - share), 0.25, 4.0))
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, batch):
            pick = order[k : k + batch]
            place, at = C.gather(np.arange(len(slots)), offsets, pick)
            s, x = slots[place], values[place]
            raw, sums = m.raw(s, x, at)
            slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) * weight[pick] / len(pick)
            per = np.repeat(slope, np.diff(at)) * x
            used, where = np.unique(s, return_inverse=True)
            d_w = np.bincount(where, per, len(used)) + decay * m.linear[used]
            full = per[:, None] * (np.repeat(sums, np.diff(at), 0) - m.factors[s] * x[:, None])
            d_v = np.stack([np.bincount(where, full[:, f], len(used)) for f in range(full.shape[1])], 1) + decay * m.factors[used]
            d_b = slope.sum()
            g_b += d_b * d_b
            g_w[used] += d_w * d_w
            g_v[used] += d_v * d_v
            m.bias -= rate * d_b / np.sqrt(g_b)
            m.linear[used] -= rate * d_w / np.sqrt(g_w[used])
            m.factors[used] -= rate * d_v / np.sqrt(g_v[used])
    return m


def _meta(batch: pa.RecordBatch, n: int) -> list[np.ndarray]:
    return [C.column(batch, f"m{k}").cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for k in range(n)]


def _vectors(batches: Iterator[pa.RecordBatch], meta: int, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, "text"):
            slots, values, at = features(*C.flat(C.column(part, "text")), _meta(part, meta), bits)
            cuts = range(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    C.column(part, "doc_id"),
                    C.column(part, "label"),
                    pa.array([slots[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in cuts], pa.binary()),
                    pa.array([values[at[i] : at[i + 1]].astype(np.float32).tobytes() for i in cuts], pa.binary()),
                ],
                ["doc_id", "label", "slots", "vals"],
            )


def _scores(batches: Iterator[pa.RecordBatch], model, text: str, keep: list[str], meta: int) -> Iterator[pa.RecordBatch]:
    m = model.value
    for batch in batches:
        for part in C.slices(batch, text):
            score = m.score(*features(*C.flat(C.column(part, text)), _meta(part, meta), m.bits))
            yield pa.RecordBatch.from_arrays([*(C.column(part, k) for k in keep), pa.array(score)], [*keep, "score"])


def _inputs(docs: DataFrame, text_col: str, meta_cols: tuple[str, ...]) -> list[Column]:
    return [docs[text_col].alias("text"), *(docs[c].cast("double").alias(f"m{k}") for k, c in enumerate(meta_cols))]


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_key: Column | None = None, id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple[str, ...] = (), max_rows: int = 4000, bits: int = 17, **options) -> FactorisationMachine:
    """Fit on the labelled rows that ``sample_key`` (a condition on ``doc_id``) admits, ``max_rows`` at most.

    Rows are taken in the order of a hash of their id, so a larger corpus gives
    a sample of the same size, spread over all of it.
    """
    known = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.where(sample_key) if sample_key is not None else known
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # max_rows ids of 12 bytes: a proven bound for the broadcast
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), *_inputs(docs, text_col, meta_cols)).join(F.broadcast(known), "doc_id")
    meta = len(meta_cols)
    rows = texts.mapInArrow(lambda it: C.trimmed(_vectors(it, meta, bits)), "doc_id long, label int, slots binary, vals binary")
    # an id that stands on several rows counts once: the driver gets max_rows rows at most
    once = rows.groupBy("doc_id").agg(F.min(F.struct("slots", "vals", "label")).alias("r")).select("doc_id", "r.*")
    got = sorted(once.collect(), key=lambda r: r.doc_id)
    slots = np.frombuffer(b"".join(bytes(r.slots) for r in got), np.int32).astype(np.int64)
    values = np.frombuffer(b"".join(bytes(r.vals) for r in got), np.float32).astype(np.float64)
    offsets = np.concatenate([[0], np.cumsum([len(r.slots) // 4 for r in got])]).astype(np.int64)
    return fit(slots, values, offsets, np.array([r.label for r in got], np.int64), bits, meta, **options)


def score(docs: DataFrame, model: FactorisationMachine, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", meta_cols: tuple[str, ...] = (), out_col: str = "score") -> DataFrame:
    """The columns named in ``keep`` and the score of each row, 0 to 1, as ``out_col``."""
    text, kept = f"o_{text_col}", [f"o_{c}" for c in keep]
    cols = docs.select(*(docs[c].alias(f"o_{c}") for c in dict.fromkeys((*keep, text_col))), *_inputs(docs, text_col, meta_cols)[1:])
    held, meta = docs.sparkSession.sparkContext.broadcast(model), len(meta_cols)
    schema = T.StructType([cols.schema[k] for k in kept] + [T.StructField("score", T.DoubleType())])
    out = cols.mapInArrow(lambda it: C.trimmed(_scores(it, held, text, kept, meta)), schema)
    return out.select(*(F.col(f"o_{c}").alias(c) for c in keep), F.col("score").alias(out_col))
