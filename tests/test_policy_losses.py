"""Losses, weights and resampling of logged policies against plain numpy."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.operators import policy_losses as P

R = np.random.default_rng(3)
OLD, NEW = R.normal(-2, 1, (5, 7)), R.normal(-1, 2, (5, 7))
ADV, MASK = R.normal(0, 2, (5, 7)), (R.random((5, 7)) < 0.7).astype(float)
MASK[2] = 0
MODES = ["token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"]


@pytest.fixture(scope="module")
def tokens(spark):
    rows = [(i, j, *(float(x[i, j]) for x in (OLD, NEW, ADV, MASK)), float(NEW[i, j] - OLD[i, j])) for i in range(5) for j in range(7)]
    return spark.createDataFrame(rows, "seq long, pos long, old double, new double, adv double, mask double, lr double").cache()


def _agg(loss, mode):
    n = MASK.sum(1)
    has, sums = n > 0, (loss * MASK).sum(1)
    return {"token-mean": (loss * MASK).sum() / n.sum(), "seq-mean-token-sum": sums[has].mean(), "seq-mean-token-mean": (sums[has] / n[has]).mean(), "seq-mean-token-sum-norm": sums.sum() / 7}[mode]


@pytest.mark.parametrize("mode", MODES)
def test_vanilla_and_gpg(tokens, mode):
    r = np.exp(NEW - OLD)
    plain, clipped = -ADV * r, -ADV * np.clip(r, 0.8, 1.2)
    most = np.maximum(plain, clipped)
    want = np.where(ADV < 0, np.minimum(-ADV * 3, most), most)
    got = P.LOSSES["vanilla"](tokens, ["seq"], "old", "new", "adv", "mask", mode=mode).first()
    mean = lambda x: (x * MASK).sum() / MASK.sum()
    assert (got.loss, got.clip_share, got.clip_share_lower, got.kl) == pytest.approx((_agg(want, mode), mean(clipped > plain), mean((most > -ADV * 3) & (ADV < 0)), mean(OLD - NEW)), rel=1e-6)
    assert got.clip_share_lower > 0
    assert P.LOSSES["gpg"](tokens, ["seq"], "new", "adv", "mask", mode=mode).first().loss == pytest.approx(_agg(-NEW * ADV, mode), rel=1e-6)


def test_gspo(tokens):
    lr = ((NEW - OLD) * MASK).sum(1) / np.maximum(MASK.sum(1), 1)
    r = np.exp(lr)[:, None]
    want = np.maximum(-ADV * r, -ADV * np.clip(r, 0.8, 1.2))
    assert P.LOSSES["gspo"](tokens, ["seq"], "old", "new", "adv", "mask").first().loss == pytest.approx(_agg(want, "seq-mean-token-mean"), rel=1e-6)


@pytest.mark.parametrize("level", ["token", "sequence"])
def test_weights(tokens, level):
    lr = NEW - OLD if level == "token" else np.repeat(((NEW - OLD) * MASK).sum(1)[:, None], 7, 1)
    want = np.minimum(np.exp(lr) * MASK, 2)
    mean = (want * MASK).sum() / MASK.sum() if level == "token" else ((want * MASK).sum(1) / (MASK.sum(1) + 1e-8)).mean()
    for normalise in (False, True):
        got = P.importance_weights(tokens, ["seq"], "lr", "mask", level, normalise=normalise).collect()
        assert all(r.is_weight == pytest.approx(want[r.seq, r.pos] / (mean if normalise else 1), rel=1e-6) for r in got)
    kept = P.rejection_mask(tokens, ["seq"], "lr", "mask", level).collect()
    assert all(r.kept == MASK[r.seq, r.pos] * (0.5 <= np.exp(lr[r.seq, r.pos]) <= 2) for r in kept)


def test_resample(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 500)
    df = spark.range(2000).select("id", (F.col("id") % 4).alias("score"))
    assert {(r.score, r.weight) for r in P.reweighted(df, "score", "max_random").collect()} == {(0, 0.1), (1, 0.1), (2, 0.1), (3, 0.4)}
    got = P.resample(P.reweighted(df, "score"), ["id"], seed=7)
    rows = got.collect()
    assert sorted(r.draw for r in rows) == list(range(2000))
    n = collections.Counter(r.score for r in rows)
    assert n[0] == 0 and all(abs(n[s] - 2000 * s * s / 14) < 5 * (2000 * s * s / 14) ** 0.5 for s in (1, 2, 3))
    assert max(collections.Counter(r.id for r in rows).values()) > 1
    again = P.resample(P.reweighted(df.repartition(3), "score"), ["id"], seed=7)
    assert {(r.draw, r.id) for r in again.collect()} == {(r.draw, r.id) for r in rows}
    assert P.resample(P.reweighted(df.limit(0), "score"), ["id"]).count() == 0
