"""Group-relative statistics and advantages of scored samples.

Every estimator is a window over the group: one shuffle on the group key, no
join back. Estimators are found by name in a registry; a name can't be taken
twice by different functions. ``row`` lists the columns that tell rows of a group
apart, for rules that pick one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESTIMATORS: dict[str, Callable] = {}


def estimator(name: str) -> Callable[[Callable], Callable]:
    def keep(fn: Callable) -> Callable:
        if ESTIMATORS.setdefault(name, fn) is not fn:
            raise ValueError(f"estimator {name} is registered twice")
        return fn

    return keep


def advantage(df: DataFrame, name: str, group: list[str], score: str, **options) -> DataFrame:
    """``df`` with the column ``advantage`` of the named estimator."""
    return ESTIMATORS[name](df, group, score, **options)


def group_stats(df: DataFrame, group: list[str], score: str, eps: float = 1e-6) -> DataFrame:
    """Mean, deviation and count of each group as columns; the variance is ``eps`` at least, a single row has mean 0 and deviation 1."""
    w = Window.partitionBy(*group)
    n, mean, var = F.count(score).over(w), F.avg(score).over(w), F.var_samp(score).over(w)
    return df.withColumn("g_n", n).withColumn("g_mean", F.when(n > 1, mean).otherwise(0.0)).withColumn("g_std", F.when(n > 1, F.sqrt(F.greatest(var, F.lit(eps)))).otherwise(1.0))


@estimator("grpo")
def grpo(df: DataFrame, group: list[str], score: str, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """(s - mean) / (sample deviation + eps); a single row has mean 0 and deviation 1. Without ``by_std`` only the mean is taken off."""
    w = Window.partitionBy(*group)
    n, s = F.count(score).over(w), F.col(score)
    mean, std = F.when(n > 1, F.avg(score).over(w)).otherwise(0.0), F.when(n > 1, _std(score, w)).otherwise(1.0)
    return df.withColumn("advantage", (s - mean) / (std + eps) if by_std else s - mean)


@estimator("grpo_vectorised")
def grpo_vectorised(df: DataFrame, group: list[str], score: str, eps: float = 1e-6) -> DataFrame:
    """As grpo, with the variance floored at eps before the root."""
    d = group_stats(df, group, score, eps)
    return d.withColumn("advantage", (F.col(score) - F.col("g_mean")) / (F.col("g_std") + eps)).drop("g_n", "g_mean", "g_std")


@estimator("grpo_best")
def grpo_best(df: DataFrame, group: list[str], score: str, row: list[str], eps: float = 1e-6) -> DataFrame:
    """The best row of a group gets (largest - second largest) / (deviation + eps), the others 0; a group of one gets 0. Ties go to the first row."""
    w = Window.partitionBy(*group)
    o = w.orderBy(F.desc(score), *row)
    second = F.lead(score).over(o)
    gap = (F.col(score) - second) / (_std(score, w) + eps)
    return df.withColumn("advantage", F.when((F.row_number().over(o) == 1) & second.isNotNull(), gap).otherwise(0.0))


@estimator("rloo")
def rloo(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """s less the mean of the others; a single row keeps its score."""
    w = Window.partitionBy(*group)
    n, s = F.count(score).over(w), F.col(score)
    return df.withColumn("advantage", F.when(n > 1, s * n / (n - 1) - F.avg(score).over(w) * n / (n - 1)).otherwise(s))


@estimator("rloo_vectorised")
def rloo_vectorised(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """(n s - sum) / (n - 1); a single row gets 0."""
    w = Window.partitionBy(*group)
    n = F.count(score).over(w)
    return df.withColumn("advantage", F.when(n > 1, (F.col(score) * n - F.sum(score).over(w)) / (n - 1)).otherwise(0.0))


@estimator("length_baseline")
def length_baseline(df: DataFrame, group: list[str], score: str, length: str) -> DataFrame:
    """s less the group's length-weighted mean; a single row has baseline 0."""
    w = Window.partitionBy(*group)
    base = F.sum(F.col(length) * F.col(score)).over(w) / F.sum(length).over(w)
    return df.withColumn("advantage", F.col(score) - F.when(F.count(score).over(w) > 1, base).otherwise(0.0))


@estimator("policy_gradient")
def policy_gradient(df: DataFrame, group: list[str], score: str, f_norm: float = 1.0) -> DataFrame:
    """alpha (s - group mean) / f_norm with alpha = rows / rows of non-zero score (1 at least); a single row has mean 0.

    The two counts are one aggregated row, broadcast.
    """
    w = Window.partitionBy(*group)
    totals = df.agg(F.count("*").alias("_n"), F.greatest(F.count(F.when(F.col(score) != 0, 1)), F.lit(1)).alias("_nz"))
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    return df.withColumn("_c", F.col(score) - mean).crossJoin(F.broadcast(totals)).withColumn("advantage", F.col("_n") / F.col("_nz") * F.col("_c") / f_norm).drop("_n", "_nz", "_c")


@estimator("baseline_whitened")
def baseline_whitened(df: DataFrame, group: list[str], score: str, length: str, eps: float = 1e-8) -> DataFrame:
    """s less the group mean, whitened over all tokens: mean and variance weigh a row by its length. A single row has mean 0."""
    w = Window.partitionBy(*group)
    mean = F.when(F.count(score).over(w) > 1, F.avg(score).over(w)).otherwise(0.0)
    return whiten(df.withColumn("_c", F.col(score) - mean), "_c", length, eps).withColumnRenamed("whitened", "advantage").drop("_c")


def whiten(df: DataFrame, value: str, weight: str, eps: float = 1e-8, shift: bool = True) -> DataFrame:
    """``whitened`` = (v - mean) / sqrt(var + eps) over all rows, each counting ``weight`` times; the variance has n/(n-1).

    The moments are one aggregated row, broadcast.
    """
    v, n = F.col(value), F.col(weight)
    m = df.agg(F.sum(n).alias("_n"), F.sum(v * n).alias("_s"), F.sum(v * v * n).alias("_q"))
    m = m.select((F.col("_s") / F.col("_n")).alias("_mean"), ((F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n")) / (F.col("_n") - 1)).alias("_var"))
    out = (v - F.col("_mean")) / F.sqrt(F.col("_var") + eps)
    return df.crossJoin(F.broadcast(m)).withColumn("whitened", out if shift else out + F.col("_mean")).drop("_mean", "_var")


def one_sided_clamp(df: DataFrame, fatal: Column, advantage_col: str = "advantage") -> DataFrame:
    """Rows marked fatal keep no negative advantage; group statistics aren't touched."""
    return df.withColumn(advantage_col, F.when(fatal, F.greatest(F.col(advantage_col), F.lit(0.0))).otherwise(F.col(advantage_col)))


def solve_status(df: DataFrame, group: list[str], correct: Column) -> DataFrame:
    """Each group's ``status``: all, none or partial of its rows are correct."""
    c = F.coalesce(correct, F.lit(False))
    return df.groupBy(*group).agg(F.when(F.bool_and(c), "all").when(F.bool_or(c), "partial").otherwise("none").alias("status"))


def reject_uniform(df: DataFrame, group: list[str], correct: Column) -> DataFrame:
    """Rows of the groups that are neither all correct nor all wrong: one window, where an anti-join would shuffle twice."""
    w = Window.partitionBy(*group)
    c = F.coalesce(correct, F.lit(False))
    return df.withColumn("_a", F.bool_and(c).over(w)).withColumn("_o", F.bool_or(c).over(w)).where("not _a and _o").drop("_a", "_o")


def keep_varied(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Rows of groups whose population deviation is above 0, or of one row."""
    w = Window.partitionBy(*group)
    return df.withColumn("_v", (F.max(score).over(w) > F.min(score).over(w)) | (F.count(score).over(w) == 1)).where("_v").drop("_v")


def _std(score: str, w) -> Column:
    """Sample deviation, exactly 0 where all values are equal."""
    return F.when(F.max(score).over(w) == F.min(score).over(w), 0.0).otherwise(F.stddev_samp(score).over(w))


def fatal_step(steps: DataFrame, episode: list[str], step: str, error: Column, termination: str, run: int = 3) -> DataFrame:
    """The first step that opens a run of ``run`` consecutive errors in each episode; else null after termination 'answer', else the number of steps."""
    w = Window.partitionBy(*episode).orderBy(step)
    bad = F.coalesce(error, F.lit(False)).cast("int")
    d = steps.withColumn("_pos", F.row_number().over(w) - 1).withColumn("_run", F.sum(bad).over(w.rowsBetween(-run + 1, 0)))
    agg = d.groupBy(*episode).agg(F.min(F.when(F.col("_run") == run, F.col("_pos") - (run - 1))).alias("_first"), F.count("*").alias("n_steps"), F.max(termination).alias("_end"))
    return agg.select(*episode, F.coalesce("_first", F.when(F.col("_end") == "answer", None).otherwise(F.col("n_steps"))).cast("long").alias("fatal_step"), "n_steps")


def step_returns(steps: DataFrame, episode: list[str], step: str, reward: str, shaping: float = 0.0, gamma: float = 1.0) -> DataFrame:
    """Rewards shaped by their change, and discounted returns from each step to the end."""
    w = Window.partitionBy(*episode).orderBy(step)
    d = steps.withColumn("_i", F.row_number().over(w) - 1)
    r = F.col(reward)
    d = d.withColumn("shaped", r + F.lit(shaping) * F.coalesce(r - F.lag(reward).over(w), F.lit(0.0)))
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return d.withColumn("mc_return", F.sum(F.col("shaped") * F.pow(F.lit(gamma), F.col("_i"))).over(ahead) / F.pow(F.lit(gamma), F.col("_i"))).drop("_i")


def mask_blocks(tokens: DataFrame, sequence: list[str], pos: str, mask: str, fatal: str) -> DataFrame:
    """``masked``: the mask with every block of ones from the ``fatal``-th (from 0) on set to 0; a null ``fatal`` changes nothing."""
    w = Window.partitionBy(*sequence).orderBy(pos)
    starts = ((F.col(mask) == 1) & (F.coalesce(F.lag(mask).over(w), F.lit(0)) == 0)).cast("int")
    d = tokens.withColumn("_start", starts).withColumn("_block", F.sum("_start").over(w) - 1)
    return d.withColumn("masked", F.when(F.col("_block") >= F.col(fatal), 0).otherwise(F.col(mask))).drop("_start", "_block")
