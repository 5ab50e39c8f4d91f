"""Functions of token arrays, as column expressions: sums under masks, returns, penalties, padding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a run, whose sums are added up one by one.
RUN = 128


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)``; ``x`` is evaluated once and stands in the plan once, however often ``fn`` uses it."""
    return F.transform(F.array(x), fn)[0]


def running_sum(x: Column) -> Column:
    """Sums (longs) of an array's whole numbers up to and with each element, over the sums of the runs before it."""

    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda t, v: t + v)

    def sums(xs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / RUN).cast("int")), lambda r: total(F.slice(xs, r * RUN + 1, RUN)))
        heads = let(runs, lambda rs: F.transform(rs, lambda _, r: total(F.slice(rs, F.lit(1), r))))
        return let(heads, lambda hs: F.transform(xs, lambda _, i: F.get(hs, F.floor(i / RUN).cast("int")) + total(F.slice(xs, i - i % RUN + 1, i % RUN + 1))))

    return let(x, sums)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def masked_sum(values: Column, mask: Column) -> Column:
    """Sum where the mask is on; what lies outside, NaN included, doesn't count."""
    return array_sum(F.zip_with(values, mask, lambda v, m: F.when(m == 1, v).otherwise(0.0)))


def masked_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(values, mask) / (array_sum(F.transform(mask, lambda m: m.cast("double"))) + eps)


def masked_var(values: Column, mask: Column) -> Column:
    """Variance under the mask with n / (n - 1); null for fewer than two values."""
    n = array_sum(F.transform(mask, lambda m: m.cast("double")))
    mean = masked_mean(values, mask)
    square = masked_mean(F.transform(values, lambda v: (v - mean) * (v - mean)), mask)
    return F.when(n > 1, square * n / (n - 1))


def discounted_returns(rewards: Column, mask: Column, gamma: float = 1.0) -> Column:
    """Reverse discounted sums that start anew after a masked token."""
    pairs = F.reverse(F.arrays_zip(rewards.alias("r"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        now = p["r"] + F.lit(gamma) * acc["run"]
        return F.struct(F.when(p["m"] == 1, now).otherwise(0.0).alias("run"), F.concat(F.array(now), acc["out"]).alias("out"))

    return F.aggregate(pairs, start, step, lambda a: a["out"])


def gae(rewards: Column, values: Column, mask: Column, gamma: float = 1.0, lam: float = 0.95) -> Column:
    """Generalised advantage estimates, back to front; masked tokens pass the state on and get the estimate behind them."""
    rows = F.reverse(F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m")))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        delta = x["r"] + F.lit(gamma) * a["next"] - x["v"]
        now = delta + F.lit(gamma * lam) * a["last"]
        on = x["m"] == 1
        last = F.when(on, now).otherwise(a["last"])
        return F.struct(F.when(on, x["v"]).otherwise(a["next"]).alias("next"), last.alias("last"), F.concat(F.array(last), a["out"]).alias("out"))

    return F.aggregate(rows, start, step, lambda a: a["out"])


def kl_penalty(logp: Column, ref: Column, kind: str = "k1") -> Column:
    """Per-token estimates of divergence: k1 (difference), abs, k2 (half square), k3 (low variance, clamped)."""
    d = logp - ref
    if kind in ("k1", "kl"):
        return d
    if kind == "abs":
        return F.abs(d)
    if kind in ("k2", "mse"):
        return 0.5 * d * d
    if kind in ("k3", "low_var_kl"):
        x = F.greatest(F.least(-d, F.lit(20.0)), F.lit(-20.0))
        return F.greatest(F.least(F.exp(x) - x - 1, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"no penalty {kind}")


def penalised(scores: Column, logp: Column, ref: Column, beta: float) -> Column:
    return F.zip_with(scores, F.zip_with(logp, ref, lambda a, b: (a - b) * beta), lambda s, k: s - k)


def pad(x: Column, size: int, value, left: bool = False) -> Column:
    """An array brought to ``size`` with ``value``; a longer one stays."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(size) - F.size(x), F.lit(0)))
    return F.concat(fill, x) if left else F.concat(x, fill)


def truncate(x: Column, size: int, how: str = "right") -> Column:
    """An array cut to ``size``: from the right, from the left, or out of the middle."""
    n = F.size(x)
    if how == "right":
        return F.slice(x, 1, size)
    if how == "left":
        return F.when(n > size, F.slice(x, n - size + 1, F.lit(size))).otherwise(x)
    if how == "middle":
        return F.when(n > size, F.concat(F.slice(x, 1, size // 2), F.slice(x, n - (size - size // 2) + 1, F.lit(size - size // 2)))).otherwise(x)
    if how == "error":
        return F.when(n > size, F.raise_error(F.concat(F.lit("sequence is longer than "), F.lit(size)))).otherwise(x)
    raise ValueError(f"no truncation {how}")


def mask_to_first(x: Column, stop: int) -> Column:
    """1 up to and with the first ``stop``, 0 after it; all 1 without one."""
    at = F.array_position(x, F.lit(stop))
    return F.transform(x, lambda v, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def length_budget(source: Column, target: Column, cutoff: Column) -> Column:
    """How many of source and target tokens fit into ``cutoff``: a short side is kept whole, else both shrink in proportion."""
    most = F.when(target * 2 < cutoff, cutoff).when(source * 2 < cutoff, cutoff - source).otherwise((cutoff * (target / (source + target))).cast("int"))
    kept = F.least(target, most)
    return F.struct(F.least(source, F.greatest(cutoff - kept, F.lit(0))).cast("int").alias("source_len"), kept.cast("int").alias("target_len"))
