"""Sinks: atomic tables, sorted JSON lines, partitioned logs, reports, token tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _fs(df: DataFrame, path: str):
    jvm = df.sparkSession._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str, key: list[str]) -> None:
    """Write ``df`` in order of its key beside ``path``, then put it in its place by renames: readers see the old table or the new one."""
    staging = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.orderBy(*key).write.parquet(staging)
    old, fs = _fs(df, path)
    new, _ = _fs(df, staging)
    if fs.exists(old):
        gone, _ = _fs(df, f"{staging}.old")
        fs.rename(old, gone)
        fs.rename(new, old)
        fs.delete(gone, True)
    else:
        fs.rename(new, old)


def write_json_lines(df: DataFrame, path: str, key: list[str] | None = None) -> None:
    """One object a line, with its fields in alphabetical order."""
    rows = df.orderBy(*key) if key else df
    rows.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.mode("overwrite").text(path)


def write_log(df: DataFrame, path: str, by: list[str]) -> None:
    """Append rows to a log laid out by mode, epoch, step or the like."""
    df.write.mode("append").partitionBy(*by).json(path)


def write_report(details: DataFrame, path: str, correct: str) -> DataFrame:
    """Details as JSON lines and a report row: accuracy in per cent over rows that have a verdict."""
    details.write.mode("overwrite").json(f"{path}/details")
    report = details.agg(F.coalesce(100 * F.avg(F.col(correct).cast("double")), F.lit(0.0)).alias("accuracy"), F.count(correct).alias("n"))
    report.write.mode("overwrite").json(f"{path}/report")
    return report


def merge_token_tables(parts: list[DataFrame], doc: str = "doc_id") -> DataFrame:
    """Token tables one after the other, document numbers shifted by the largest number before."""
    out, base = parts[0], parts[0].agg(F.max(doc)).first()[0]
    for p in parts[1:]:
        shift = (base if base is not None else -1) + 1
        top = p.agg(F.max(doc)).first()[0]
        out = out.unionByName(p.withColumn(doc, F.col(doc) + shift))
        base = shift + top if top is not None else base
    return out
