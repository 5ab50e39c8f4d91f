"""What Python workers are handed at once, and what they keep after a task."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from gleanery.llm import common as C


def test_stages_hand_over_texts_in_small_batches(spark):
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 20_000, " word").alias("text"))
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        corpus_pipeline.tokens(spark, docs, "")
        got = docs.mapInArrow(lambda it: (pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]}) for b in it), "rows long, size long").collect()
        assert sum(r.rows for r in got) == 3000
        assert max(r.size for r in got) < 3 * C.BATCH_BYTES
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1000")
        corpus_pipeline.tokens(spark, docs, "")
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1000"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", held)


def _resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


def test_a_task_leaves_no_freed_memory_behind():
    def work():
        pieces = [np.ones(12_000) for _ in range(1000)]  # 96 MB below malloc's threshold of pages of their own
        pin = np.ones(12_000)  # what stays at the heap's end keeps the rest there
        del pieces
        yield pin

    kept, before = [], _resident()
    kept += C.trimmed(work())
    assert _resident() - before < 30 << 20
