"""Operators of evaluation: accuracy reports, pass rates, votes, bootstraps, metric tables, answer matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbers that groups of one size are resampled to at once.
CELLS = 1 << 18


def pass_rates(results: DataFrame, task: list[Column], reward: str) -> DataFrame:
    """pass@1 (share of rewards above 0) and pass@k (share of tasks with one); tasks are told apart by a digest of ``task``."""
    key = F.md5(F.to_json(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(task)))))
    per = results.groupBy(key.alias("task")).agg(F.count("*").alias("n"), F.sum((F.col(reward) > 0).cast("long")).alias("ok"))
    return per.agg((F.sum("ok") / F.sum("n")).alias("pass_at_1"), F.avg((F.col("ok") > 0).cast("double")).alias("pass_at_k"), F.count("*").alias("n_tasks"))


def source_pass_rates(results: DataFrame, source: str, task: str, reward: str) -> DataFrame:
    """Per source: mean reward, and share of tasks with any reward above 0."""
    per = results.groupBy(source, task).agg(F.sum(reward).alias("s"), F.count("*").alias("n"), F.bool_or(F.col(reward) > 0).alias("any"))
    return per.groupBy(source).agg((F.sum("s") / F.sum("n")).alias("mean_reward"), F.avg(F.col("any").cast("double")).alias("pass_at_k"))


def majority(rows: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """Of each group the most frequent vote (ties: the first seen) and the value of its first row. Votes are counted before groups meet."""
    votes = rows.groupBy(*group, vote).agg(F.count("*").alias("n"), F.min(F.struct(order, value)).alias("first"))
    best = votes.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(vote).alias("vote"))).alias("b"))
    return best.select(*group, F.col("b.vote").alias("majority"), F.col(f"b.first.{value}").alias("value"), (-F.col("b.n")).alias("votes"))


def expected_best(values: Column, n: int, largest: bool = True) -> Column:
    """The exact mean of the largest (smallest) of ``n`` draws with replacement from a list: what a bootstrap of it estimates."""
    x = F.array_sort(values) if largest else F.reverse(F.array_sort(values))
    size = F.size(values).cast("double")
    return F.aggregate(F.transform(x, lambda v, i: v * (F.pow((i + 1) / size, F.lit(n)) - F.pow(i / size, F.lit(n)))), F.lit(0.0), lambda a, v: a + v)


def _resampled(x: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Mean and deviation of the largest, then of the least draws; a row of ``x`` is a sorted group, ``most`` and ``least`` are their places. NaN stands last and spoils each draw that holds it."""
    hi, lo = np.take(x, most, axis=1), np.take(x, least, axis=1)
    lo[np.isnan(hi)] = np.nan
    return np.stack([hi.mean(1), hi.std(1), lo.mean(1), lo.std(1)])


def bootstrap(rows: DataFrame, group: str, value: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and deviation of the largest and least of ``n`` draws, over ``draws`` seeded resamples of each group (a task's responses: a bounded group).

    What is drawn depends on a group's size alone, so that a batch's groups of one size are resampled together.
    """
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column(1)
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes, out = np.diff(starts), np.empty((len(names), len(lists)))
            for size in np.unique(sizes):
                if size not in places:
                    picked = np.random.Generator(np.random.PCG64(seed)).integers(0, size, (draws, n))
                    places[size] = picked.max(1), picked.min(1)
                of = np.flatnonzero(sizes == size)
                step = max(1, CELLS // max(size, draws))
                for at in range(0, len(of), step):
                    some = of[at : at + step]
                    out[:, some] = _resampled(np.sort(flat[starts[some][:, None] + np.arange(size)], axis=1), *places[size])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, from_pandas=True) for c in out)], [group, *names])

    kind = dict(rows.dtypes)[group]
    lists = rows.groupBy(group).agg(F.collect_list(F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))).alias("v"))
    return lists.mapInArrow(resample, ", ".join([f"{group} {kind}", *(f"{c} double" for c in names)]))


def reduce_by_name(metrics: DataFrame, name: str, value: str) -> DataFrame:
    """Names with 'max' take the largest value, with 'min' the least, others the mean."""
    n = F.col(name)
    return metrics.groupBy(name).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.avg(value).alias("_m")).select(name, F.when(n.contains("max"), F.col("_hi")).when(n.contains("min"), F.col("_lo")).otherwise(F.col("_m")).alias("value"))


def timing_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Total, mean, least, largest and upper median (sorted[n // 2]) of each key. The median is a rank found by counts of distinct values."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("_to", F.sum("_n").over(run)).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    mid = F.floor(F.col("_all") / 2)
    return ranked.groupBy(key).agg(F.sum("_n").alias("n"), F.sum(F.col(value) * F.col("_n")).alias("total"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("largest"), F.min(F.when(F.col("_to") > mid, F.col(value))).alias("p50"))


def category_accuracy(rows: DataFrame, category: str, correct: Column) -> DataFrame:
    """Accuracy and count of each category and of all rows ('Average')."""
    r = rows.rollup(category).agg(F.avg(correct.cast("double")).alias("accuracy"), F.count("*").alias("n"), F.grouping(category).alias("_g"))
    return r.select(F.when(F.col("_g") == 1, "Average").otherwise(F.col(category)).alias("category"), "accuracy", "n")


def domain_accuracy(rows: DataFrame, domain: str, category: str, correct: Column) -> DataFrame:
    """Accuracy of categories, of domains (weighted by their rows) and of everything, rounded to 4."""
    r = rows.rollup(domain, category).agg(F.round(F.avg(correct.cast("double")), 4).alias("accuracy"), F.count("*").alias("n"), F.grouping_id().alias("_g"))
    return r.select(F.coalesce(domain, F.lit("Overall")).alias("domain"), F.when(F.col("_g") == 0, F.col(category)).otherwise("*").alias("category"), "accuracy", "n")


def first_of_duplicates(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key over all shards; others are dropped."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def option_match(answer: Column, gold: Column, strict: bool = False) -> Column:
    """First words contained in one another, in lower case without final dots. An empty answer counts as correct, unless ``strict``."""
    word = lambda c: F.rtrim(F.substring_index(F.lower(F.trim(c)), " ", 1), F.lit("."))
    a, g = word(answer), word(gold)
    hit = g.contains(a) | a.contains(g)
    return hit & (a != "") if strict else hit


def choice(response: Column, choices: list[str]) -> Column:
    """The choice that stands last in brackets, else last as a single letter; the first choice without any."""

    def last(mark) -> Column:
        places = [F.struct((F.length(response) - F.instr(F.reverse(response), mark(c)[::-1])).alias("p"), F.lit(c).alias("c")) for c in choices]
        seen = F.filter(F.array(*places), lambda s: s["p"] < F.length(response))
        return F.array_max(seen)["c"]

    return F.coalesce(last(lambda c: f"({c})"), last(lambda c: f" {c} "), F.lit(choices[0]))


def containment(rows: DataFrame, kind: str, answer: str, golds: str, strict: bool = False) -> DataFrame:
    """Per kind, how many gold answers stand in their row's answer (lower case); every gold counts, or each row once if ``strict``."""
    hits = F.size(F.filter(golds, lambda g: F.lower(answer).contains(F.lower(g))))
    return rows.groupBy(kind).agg(F.sum(F.least(hits, F.lit(1)) if strict else hits).cast("long").alias("score"))


def decimal_answer(text: Column) -> Column:
    """A number cut (not rounded) to 2 decimals without zero decimals, percent signs and final dots."""
    t = F.rtrim(F.replace(text, F.lit("%"), F.lit("")), F.lit("."))
    cut = F.regexp_replace(t, r"(\.\d{2})\d+$", "$1")
    return F.regexp_replace(F.regexp_replace(cut, r"(\.\d*?)0+$", "$1"), r"\.$", "")
