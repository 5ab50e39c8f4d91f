"""Structured Streaming: file sources, watermarked windows, deduplicated and upserting sinks, bounded queues."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.operators import stores


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_per_trigger: int = 64) -> DataFrame:
    """An unbounded table of the files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(path)


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and kind; rows later than the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), kind)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def distinct_stream(events: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def bounded_queue(events: DataFrame, key: str, item: str, order: str, capacity: int) -> DataFrame:
    """key, item, dropped: a queue per key that holds ``capacity`` items and drops the oldest; each batch yields what it dropped and holds.

    The state is the queue itself, so it is bounded whatever the stream.
    """

    def step(name, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, dropped = state.get if state.exists else ([], 0)
        for f in frames:
            held = held + f.sort_values(order)[item].tolist()
        over = max(0, len(held) - capacity)
        held, dropped = held[over:], dropped + over
        state.update((held, dropped))
        yield pd.DataFrame({key: [name[0]] * len(held), item: held, "dropped": [dropped] * len(held)})

    kinds = dict(events.dtypes)
    return events.select(key, item, order).groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {item} {kinds[item]}, dropped long", f"held array<{kinds[item]}>, dropped long", "update", "NoTimeout")


def upsert_stream(events: DataFrame, path: str, checkpoint: str, key: list[str], order: str):
    """A streaming query that folds each micro-batch into a keyed table, written as a new version; a batch that is run again gives the same table."""

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = stores.last_by_key(batch, key, F.col(order))
        if number:
            new = stores.upsert(spark.read.parquet(f"{path}/v{number - 1}"), new, key, order)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()
