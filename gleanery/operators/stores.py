"""Operators of keyed tables: upserts, trace and session stores, result caches.

A store is a DataFrame and a statement gives a new one; who calls writes it.
Upserts are one aggregation over old and new rows by key, so a key with many
versions is folded before rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_by_key(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last version of each key; a null key is an error."""
    for k in key:
        rows = rows.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"a row has no {k}"))).otherwise(F.col(k)))
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Whole rows replaced by key; of several new rows the last in ``order`` stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_by_key(both, key, F.struct("_new", order)).drop("_new")


def store_traces(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Traces (id, ..., created_at, updated_at) replaced by id; those that were there keep created_at, all get ``now`` as updated_at."""
    n = new.withColumn("updated_at", now).withColumn("_new", F.lit(1))
    both = old.withColumn("_new", F.lit(0)).unionByName(n, allowMissingColumns=True)
    rest = [c for c in old.columns if c not in ("id", "created_at")]
    out = both.groupBy("id").agg(F.min(F.when(F.col("_new") == 0, F.col("created_at"))).alias("_was"), F.max_by(F.struct(*rest, F.col("_new").alias("_n")), F.struct("_new", "updated_at")).alias("r"))
    return out.select("id", F.coalesce("_was", now).alias("created_at"), *(F.col(f"r.{c}").alias(c) for c in rest)).select(*old.columns)


def store_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Junction rows (trace_id, session_uid): those of every trace in ``new`` are replaced by its own."""
    return old.join(new.select("trace_id").distinct(), "trace_id", "left_anti").unionByName(new.distinct())


def query_traces(traces: DataFrame, sessions: DataFrame | None = None, session_uids: list | None = None, kinds: list | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Traces by session, kind and time, latest first; a limit is a top-k."""
    out = traces
    if session_uids is not None:
        chosen = sessions.where(F.col("session_uid").isin(session_uids)).select(F.col("trace_id").alias("id")).distinct()
        out = out.join(chosen, "id", "left_semi")
    if kinds is not None:
        out = out.where(F.col("context_type").isin(kinds))
    if since is not None:
        out = out.where(F.col("created_at") >= since)
    out = out.orderBy(F.desc("created_at"), "id") if limit else out
    return out.limit(limit) if limit else out


def touch(cache: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Cache rows read ``n`` times: last_accessed becomes now, access_count grows."""
    n = hits.groupBy("hash").agg(F.count("*").alias("_n"))
    d = cache.join(n, "hash", "left")
    return d.withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0))).withColumn("last_accessed", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_accessed"))).drop("_n")


def put(cache: DataFrame, entries: DataFrame, now: Column, most_bytes: int = 100 << 20) -> DataFrame:
    """New results replace old ones and count one access; results above ``most_bytes`` aren't cached."""
    fresh = entries.where(F.octet_length("result") <= most_bytes).select("hash", "input", "result", now.alias("created_at"), now.alias("last_accessed"), F.lit(1).cast("long").alias("access_count"))
    return upsert(cache, fresh, ["hash"], "input")


def expire(cache: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    return cache.where(F.col("last_accessed") >= now - F.make_interval(secs=F.lit(max_age_seconds)))


def fan_out(traces: DataFrame, uids: str = "session_uids") -> DataFrame:
    """A row for each session of a trace's chain."""
    return traces.select(F.explode(uids).alias("session_uid"), F.col("id").alias("trace_id")).distinct()


def newest(rows: DataFrame, key: str, order: Column, most: int) -> DataFrame:
    """A bounded queue per key that drops its oldest rows: the ``most`` newest of each."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order.desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
