"""Operators of batches of rows: columns picked, popped and renamed, rows by number, frontiers, mini-batches, splits, folds, meta data."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.operators.datasets import numbered_key, with_position


def find(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """Rows for which ``predicate`` holds (a null doesn't), or all rows."""
    return df if predicate is None else df.where(predicate)


def pop_columns(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The named columns, and the others; an unknown name is an error."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no columns {missing}")
    return df.select(*names), df.select(*(c for c in df.columns if c not in names))


def rename_columns(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def reorder(df: DataFrame, pos: str, permutation: DataFrame) -> DataFrame:
    """Row ``permutation.src`` at place ``permutation.pos``: a join, so neither side meets in one task."""
    moved = permutation.select(F.col("pos").alias("_to"), F.col("src").alias(pos))
    return df.join(moved, pos).withColumn(pos, F.col("_to")).drop("_to")


def rows_at(df: DataFrame, pos: str, wanted: DataFrame) -> DataFrame:
    """Rows whose place is in ``wanted.pos``; places outside the table are left out."""
    return df.join(wanted.select(F.col("pos").alias(pos)).distinct(), pos, "left_semi")


def slice_of(df: DataFrame, predicate: Column, order: list[str], start: int, end: int | None = None, limit: int | None = None) -> DataFrame:
    """Of the rows that fulfil ``predicate``, numbered from 0, those from ``start`` up to ``end`` or ``limit`` further on."""
    stop = end if end is not None else start + limit if limit is not None else None
    rows = with_position(df.where(predicate), order)
    return rows.where((F.col("pos") >= start) & (F.lit(True) if stop is None else F.col("pos") < stop))


def first_present(*columns: Column) -> Column:
    """The first that isn't null; an empty text counts as present."""
    return F.coalesce(*columns)


def first_filled(*columns: Column) -> Column:
    """The first text that is neither null nor empty, else the empty one."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def prompt_of(prompt: Column, question: Column, query: Column) -> Column:
    """The first message's content, or else the question or the query, whichever is filled."""
    return F.coalesce(F.get(prompt, F.lit(0))["content"], first_filled(question, query))


def group_steps(steps: DataFrame, key: str, row: str) -> DataFrame:
    """Steps with the name of their group; a step without one is a group of its own."""
    return steps.withColumn("group", F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row-"), F.col(row).cast("string"))))


def frontier(tasks: DataFrame, url: str, seq: str, seen: DataFrame | None = None) -> DataFrame:
    """Tasks in the order in which they came, each address at its first place, without those that were ever seen."""
    first = tasks.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(seq))).where("_n = 1").drop("_n")
    return first if seen is None else first.join(seen.select(url).distinct(), url, "left_anti")


def split_of(key: Column, val_size: float, n: int) -> Column:
    """Whether a row's place in a shuffle is in the validation part: ``val_size`` rows if above 1, else that share."""
    most = int(val_size) if val_size > 1 else math.floor(n * val_size)
    return F.when(key < most, "validation").otherwise("train")


def train_val_split(df: DataFrame, id_col: str, val_size: float, seed: int = 42) -> DataFrame:
    """Rows with their part, in a seeded shuffle that is the same at every partitioning."""
    n = df.count()
    rows = with_position(df.withColumn("_h", numbered_key(seed, id_col)), ["_h", id_col], "_p")
    return rows.withColumn("part", split_of(F.col("_p"), val_size, n)).drop("_h", "_p")


def resized(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows: a prefix of a seeded shuffle, and if there are fewer rows, all and then ``draw``s with replacement."""
    have = df.count()
    rows = with_position(df.withColumn("_h", numbered_key(seed, id_col)), ["_h", id_col], "_p").drop("_h")
    first = rows.where(F.col("_p") < n).withColumn("draw", F.lit(0).cast("long"))
    if n <= have or not have:
        return first.drop("_p")
    # a draw's row is a digest of its number
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("draw"), "draw")), 1, 13), 16, 10).cast("long")
    draws = df.sparkSession.range(1, n - have + 1).select(F.col("id").alias("draw")).withColumn("_p", digest % have)
    return first.unionByName(rows.join(draws, "_p").select(*first.columns)).drop("_p")


def mini_batches(df: DataFrame, id_col: str, size: int, epochs: int, seed: int = 42) -> DataFrame:
    """Each row once an epoch, with epoch, batch and its place in the batch; every epoch has a shuffle of its own."""
    n = df.count()
    times = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "epoch", id_col)), 1, 12), 16, 10).cast("long") + F.col("epoch").cast("long") * (1 << 48)
    rows = with_position(times.withColumn("_h", h), ["_h", id_col], "_p")
    at = F.col("_p") - F.col("epoch") * n
    return rows.withColumn("batch", F.floor(at / size)).withColumn("at", at % size).drop("_h", "_p")


def document_index(docs: DataFrame, id_col: str, epochs: int, separate_last: bool = False, seed: int = 1) -> DataFrame:
    """Document numbers of all epochs in one shuffle; with ``separate_last`` the last epoch is shuffled for itself and comes last."""
    part = F.when(F.lit(separate_last) & (F.col("epoch") == epochs - 1), 1).otherwise(0)
    times = docs.select(id_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "epoch", id_col)), 1, 12), 16, 10).cast("long") + part.cast("long") * (1 << 48)
    return with_position(times.withColumn("_h", h), ["_h", id_col, "epoch"]).drop("_h")


def blend_sizes(weights: list[float], targets: list[int], surplus: float = 0.0) -> list[list[int]]:
    """Samples to ask of each data set for each split."""
    total = sum(weights)
    return [[math.ceil(math.ceil(t * w / total) * (1 + surplus)) for t in targets] for w in weights]


def exhaustive_blend(rows: DataFrame, dataset: str, row: str) -> DataFrame:
    """All rows of all data sets in one order, in which each data set is always near its share of what came so far.

    Row r of n is due at (r + 1/2) / n of the way, so any prefix holds each data
    set within a row or so of its share: no loop over draws.
    """
    n = rows.groupBy(dataset).agg(F.count("*").alias("_n"))
    due = ((F.col(row) + 0.5) / F.col("_n")).alias("due")
    return with_position(rows.join(F.broadcast(n), dataset).select(*rows.columns, due), ["due", dataset], "place")  # a row for each data set


def fold(rows: DataFrame, row: str, n_groups: int, total: int, columns: list[str]) -> DataFrame:
    """``n_groups`` rows of total / n_groups consecutive rows each, as arrays."""
    if total % n_groups:
        raise ValueError("rows don't fill the groups")
    grouped = rows.groupBy(F.floor(F.col(row) / (total // n_groups)).alias("group")).agg(F.array_sort(F.collect_list(F.struct(row, *columns))).alias("_r"))
    return grouped.select("group", *(F.col(f"_r.{c}").alias(c) for c in columns))


def unfold(groups: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of (group, at) again."""
    return groups.select("group", F.posexplode(F.arrays_zip(*columns)).alias("at", "_r")).select("group", "at", "_r.*")


def merged_metrics(metrics: list[Column]) -> Column:
    """Maps one after the other, a later value of a key in place of an earlier one."""
    pairs = F.concat(*(F.map_entries(m) for m in metrics))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), -1)["value"]))


def lists_of_metrics(df: DataFrame, metrics: str, order: str) -> DataFrame:
    """name and the values of all rows in order: a list of maps as a map of lists."""
    rows = df.select(order, F.explode(metrics).alias("name", "value"))
    values = F.array_sort(F.collect_list(F.struct(order, "value")))
    return rows.groupBy("name").agg(F.transform(values, lambda x: x["value"]).alias("values"))


def human_bytes(size: Column) -> Column:
    """Whole bytes below 1024, else two decimals of the largest unit of 1024 that fits."""
    out = F.concat(size.cast("long").cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.2f", F.bround(size / float(1024**k), 2)), F.lit(f" {unit}"))).otherwise(out)
    return out


def human_seconds(seconds: Column) -> Column:
    rest = F.format_string("%.2fs", seconds - F.floor(seconds / 60) * 60)
    hours, minutes = F.floor(seconds / 3600).cast("string"), F.floor(seconds / 60)
    short = F.concat(minutes.cast("string"), F.lit("m "), rest)
    long = F.concat(hours, F.lit("h "), (minutes % 60).cast("string"), F.lit("m "), rest)
    return F.when(seconds < 60, F.format_string("%.2fs", seconds)).when(minutes < 60, short).otherwise(long)


def padded(rows: DataFrame, batch: str, order: str, ids: str, pad: int, ignore: int = -100) -> DataFrame:
    """A row for each of a batch: its ids padded to the longest of the batch, the attention mask and the labels."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("_n"))
    fill = F.col("_n") - F.size(ids)
    joined = rows.join(longest, batch)
    mask = F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), fill))
    return joined.select(batch, order, F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("input_ids"), mask.alias("attention_mask"), F.concat(ids, F.array_repeat(F.lit(ignore), fill)).alias("labels"))


def model_flops(batch: Column, length: Column, hidden: int, inner: int, heads: int, kv_heads: int, layers: int, vocab: int, tied: bool = False, backward: bool = True, recompute: bool = False, flash: bool = False) -> Column:
    """Floating-point operations of one step of a decoder."""
    per_token = layers * (6 * hidden * inner + 4 * hidden * hidden + 2 * (2 * hidden * hidden * kv_heads // heads))
    scores = batch * layers * 4 * hidden * length * length
    embedding = batch * length * hidden * vocab * (1 if tied else 2)
    passes = (3 if backward else 1) + (1 if recompute else 0)
    return (passes * (batch * length * per_token + scores) + (3 if backward else 1) * embedding + (scores if flash else 0)).cast("long")


def all_of(parts: list[DataFrame]) -> DataFrame:
    """Named subsets as one table."""
    return reduce(DataFrame.unionByName, parts)
