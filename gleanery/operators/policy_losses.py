"""Losses of logged policies, importance weights and resampling, over one row for each token.

``sequence`` lists the columns that tell sequences apart, ``mask`` is 1 for tokens
that count and 0 for others. A token's loss needs its own row and, at most, a
window over its sequence; losses are aggregated over sequences before they meet.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.storage import materialize

LOSSES: dict[str, Callable] = {}
TINY, SAFE = 1e-8, 20.0
#: Rows of a bucket of :func:`resample`, on average, and buckets at most.
BUCKET_ROWS, BUCKETS = 100_000, 1024


def policy_loss(name: str) -> Callable[[Callable], Callable]:
    def keep(fn: Callable) -> Callable:
        if LOSSES.setdefault(name, fn) is not fn:
            raise ValueError(f"loss {name} is registered twice")
        return fn

    return keep


def _masked(value: Column, mask: str) -> Column:
    return F.when(F.col(mask) != 0, value * F.col(mask)).otherwise(0.0)


def _clamp(value: Column, low: float | None, high: float) -> Column:
    value = F.least(value, F.lit(float(high)))
    return value if low is None else F.greatest(value, F.lit(float(low)))


def _mean(value: Column, mask: str) -> Column:
    return F.sum(_masked(value, mask)) / (F.sum(mask) + TINY)


def aggregated(tokens: DataFrame, sequence: list[str], mask: str, mode: str = "token-mean", length: int | None = None) -> DataFrame:
    """One row: loss of the tokens' ``_loss``, and clip_share, clip_share_lower and kl of their ``_clip``, ``_lower`` and ``_lr``.

    ``length`` divides in seq-mean-token-sum-norm: the width of the batch, by default the most tokens of a sequence.
    """
    sums = [F.sum(_masked(F.col(c), mask)).alias(c) for c in ("_loss", "_clip", "_lower", "_lr")]
    seqs = tokens.groupBy(*sequence).agg(*sums, F.sum(mask).alias("_m"), F.count("*").alias("_n"))
    has = F.when(F.col("_m") > 0, 1.0).otherwise(0.0)
    loss = {
        "token-mean": F.sum("_loss") / (F.sum("_m") + TINY),
        "seq-mean-token-sum": F.sum(F.col("_loss") * has) / (F.sum(has) + TINY),
        "seq-mean-token-mean": F.sum(F.col("_loss") / (F.col("_m") + TINY) * has) / (F.sum(has) + TINY),
        "seq-mean-token-sum-norm": F.sum("_loss") / (F.max("_n") if length is None else F.lit(length)),
    }
    if mode not in loss:
        raise ValueError(f"no aggregation is named {mode}")
    share = lambda c: F.sum(c) / (F.sum("_m") + TINY)
    return seqs.agg(loss[mode].alias("loss"), share("_clip").alias("clip_share"), share("_lower").alias("clip_share_lower"), (-share("_lr")).alias("kl"))


def _weighted(tokens: DataFrame, loss: Column, clip: Column, lower: Column, lr: Column, weight: str | None) -> DataFrame:
    return tokens.withColumns({"_loss": loss if weight is None else loss * F.col(weight), "_clip": clip.cast("double"), "_lower": lower.cast("double"), "_lr": lr})


@policy_loss("vanilla")
def vanilla(tokens: DataFrame, sequence: list[str], old: str, new: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2, dual: float = 3.0, mode: str = "token-mean", weight: str | None = None, length: int | None = None) -> DataFrame:
    """The clipped loss; where the advantage is negative it is ``dual`` times its size at most."""
    if dual <= 1:
        raise ValueError("the dual clip must be above 1")
    lr, a = _clamp(F.col(new) - F.col(old), -SAFE, SAFE), F.col(advantage)
    r = F.exp(lr)
    plain, clipped, bound = -a * r, -a * _clamp(r, 1 - low, 1 + high), -a * dual
    most = F.greatest(plain, clipped)
    loss = F.when(a < 0, F.least(bound, most)).otherwise(most)
    return aggregated(_weighted(tokens, loss, clipped > plain, (most > bound) & (a < 0), lr, weight), sequence, mask, mode, length)


@policy_loss("gspo")
def gspo(tokens: DataFrame, sequence: list[str], old: str, new: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.2, weight: str | None = None) -> DataFrame:
    """The clipped loss with a sequence's geometric mean ratio, as the mean of sequences' token means."""
    w = Window.partitionBy(*sequence)
    lr, a = F.col(new) - F.col(old), F.col(advantage)
    mean = F.sum(_masked(lr, mask)).over(w) / F.greatest(F.sum(mask).over(w), F.lit(1))
    d = tokens.withColumn("_r", F.exp(_clamp(mean, None, 10.0)))
    plain, clipped = -a * F.col("_r"), -a * _clamp(F.col("_r"), 1 - low, 1 + high)
    return aggregated(_weighted(d, F.greatest(plain, clipped), clipped > plain, F.lit(0.0), lr, weight), sequence, mask, "seq-mean-token-mean")


@policy_loss("gpg")
def gpg(tokens: DataFrame, sequence: list[str], new: str, advantage: str, mask: str, mode: str = "token-mean", weight: str | None = None, length: int | None = None) -> DataFrame:
    """The plain policy gradient; only the loss."""
    zero = F.lit(0.0)
    return aggregated(_weighted(tokens, -F.col(new) * F.col(advantage), zero, zero, zero, weight), sequence, mask, mode, length).select("loss")


def _level_ratio(lr: str, sequence: list[str], mask: str, level: str) -> Column:
    w = Window.partitionBy(*sequence)
    total = F.sum(_masked(F.col(lr), mask)).over(w)
    of = {"token": F.col(lr), "sequence": total, "geometric": total / (F.sum(mask).over(w) + TINY)}
    if level not in of:
        raise ValueError(f"no level is named {level}")
    return F.exp(_clamp(of[level], -SAFE, SAFE))


def importance_weights(tokens: DataFrame, sequence: list[str], lr: str, mask: str, level: str = "token", most: float = 2.0, normalise: bool = False) -> DataFrame:
    """``is_weight`` of each token: its ratio, or its sequence's, 0 where masked, ``most`` at most; normalised to a mean of 1 over tokens (level token) or sequences' means (level sequence)."""
    if level == "geometric":
        raise ValueError("weights are of tokens or sequences")
    d = tokens.withColumn("is_weight", F.least(_level_ratio(lr, sequence, mask, level) * F.col(mask), F.lit(float(most))))
    if not normalise:
        return d
    mean = d.agg(_mean(F.col("is_weight"), mask).alias("_mean")) if level == "token" else d.groupBy(*sequence).agg(_mean(F.col("is_weight"), mask).alias("_s")).agg(F.avg("_s").alias("_mean"))
    return d.crossJoin(F.broadcast(mean)).withColumn("is_weight", F.when(F.col("_mean") > TINY, F.col("is_weight") / F.col("_mean")).otherwise(F.col("is_weight"))).drop("_mean")  # one row


def rejection_mask(tokens: DataFrame, sequence: list[str], lr: str, mask: str, level: str = "token", high: float = 2.0, low: float | None = None) -> DataFrame:
    """``kept``: the mask, 0 where the ratio of the level lies outside ``low`` (1 / ``high`` by default) to ``high``."""
    r = _level_ratio(lr, sequence, mask, level)
    return tokens.withColumn("kept", F.when(r.between(1 / high if low is None else low, high), F.col(mask)).otherwise(0))


def reweighted(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """``df`` with a ``weight``: a power of the score's size, 1 for the largest and smallest scores, or 0.4 for the largest and 0.1 for others."""
    s = F.col(score)
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(s), F.lit(float(power))))
    weights = {"max_min": F.when((s == F.col("_hi")) | (s == F.col("_lo")), 1.0).otherwise(0.0), "max_random": F.when(s == F.col("_hi"), 0.4).otherwise(0.1)}
    if method not in weights:
        raise ValueError(f"no method is named {method}")
    ends = df.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))  # one row
    return df.crossJoin(F.broadcast(ends)).withColumn("weight", weights[method]).drop("_lo", "_hi")


def resample(df: DataFrame, keys: list[str], weight: str = "weight", seed: int = 0) -> DataFrame:
    """As many rows as ``df`` has, drawn with replacement in proportion to ``weight`` + 1e-8, with the number of their ``draw``.

    ``keys`` tell rows apart. Weights are summed in hash buckets, and each draw, a
    number below the total, goes to its bucket and is looked up among the
    running sums there. Sums of buckets alone reach the driver.
    """
    spark, n = df.sparkSession, df.count()
    buckets = min(BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    of = F.greatest(F.col(weight).cast("double") + TINY, F.lit(TINY)).alias("_w")
    rows = materialize(df.select(*keys, of, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("_b")), "resample-weights")
    sums = sorted((r["_b"], r["s"]) for r in rows.groupBy("_b").agg(F.sum("_w").alias("s")).collect())
    starts = np.concatenate([[0.0], np.cumsum([s for _, s in sums])]) if sums else np.zeros(1)
    at = F.size(F.filter(F.array(*(F.lit(float(x)) for x in starts[:-1])), lambda x: x <= F.col("_u"))) if sums else F.lit(0)
    held = F.array(*(F.lit(b) for b, _ in sums)) if sums else F.array(F.lit(0))
    begin = F.array(*(F.lit(float(x)) for x in starts))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw")), F.lit(1 << 53)) / F.lit(float(1 << 53)) * F.lit(float(starts[-1]))
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("_u", u).withColumn("_at", at)
    draws = draws.select("draw", F.get(held, F.col("_at") - 1).alias("_b"), (F.col("_u") - F.get(begin, F.col("_at") - 1)).alias("_v"))

    def one(mine: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values(keys, ignore_index=True)
        spot = np.searchsorted(np.cumsum(mine["_w"].to_numpy()), drawn["_v"].to_numpy(), "right")
        out = mine[keys].iloc[np.minimum(spot, len(mine) - 1)].reset_index(drop=True)
        return pd.concat([drawn[["draw"]].reset_index(drop=True), out], axis=1)

    schema = "draw long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    picked = rows.groupBy("_b").cogroup(draws.groupBy("_b")).applyInPandas(one, schema)
    return picked.join(df, keys).select("draw", *df.columns)
