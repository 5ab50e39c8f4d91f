"""Tables that jobs share: where they lie, how they cut lineage, and when they go."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of narrow rows (a few longs each) is broadcast: some 10 MB of hash table.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; with none set, a temporary one on a single machine, and an error on a cluster."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not told:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        told = Path(tempfile.mkdtemp(prefix="gleanery-")).as_uri()
        spark.sparkContext.setCheckpointDir(told)
    return told.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/gleanery/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Delete written tables that nothing will read again: all that was made of them is written too."""
    for table in tables:
        path = table.__dict__.pop("_stored_at", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, of narrow rows, marked for broadcast if ``rows``, a bound known before, or else a count of the written table finds it small; otherwise Spark shuffles both sides."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
