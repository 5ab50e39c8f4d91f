"""Scans, sinks, registry and streams over small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources import readers as R
from gleanery.sources import writers as W
from gleanery.streaming import streams as S

ROW = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])


def test_formats(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": "a", "v": 1}, {"id": "b", "v": 2}]))
    (tmp_path / "b.jsonl").write_text('{"id": "c", "v": 3}\n')
    (tmp_path / "c.csv").write_text("id,v\nd,4\n")
    assert [R.read_files(spark, str(tmp_path / f), ROW).count() for f in ("a.json", "b.jsonl", "c.csv")] == [2, 1, 1]
    with pytest.raises(ValueError):
        R.read_files(spark, "x.doc")


def test_tolerant_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.txt").write_text('{"id": "a",\n "v": 1}\n{"id": "b", "v": 2}')
    (tmp_path / "a/y.txt").write_text('{"id": "c", "v": 3}\n\n{"id": "d", "v": 4}\n')
    assert sorted(r.id for r in R.read_tolerant_json(spark, str(tmp_path / "a"), ROW).collect()) == ["a", "b", "c", "d"]


def test_keyed_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a", "v": 1}\n\n{"id": "b", "v": 2}\n{"id": "a", "v": 9}\n')
    assert {r.id: r.v for r in R.read_keyed_lines(spark, str(tmp_path / "t.jsonl"), ROW, "id").collect()} == {"a": 9, "b": 2}
    (tmp_path / "u.jsonl").write_text('{"v": 1}\n')
    with pytest.raises(Exception, match="has no id"):
        R.read_keyed_lines(spark, str(tmp_path / "u.jsonl"), ROW, "id").collect()


def test_registry(spark, tmp_path):
    r = R.Registry(spark, str(tmp_path / "reg"))
    assert r.names() == [] and r.load("x") is None
    r.register("x", spark.range(3), "train")
    assert r.names() == ["x"] and r.load("x", "train").count() == 3 and r.load("x", "test") is None
    assert spark.read.parquet(str(tmp_path / "reg/x/train_training.parquet")).first().reward_model.style == "rule"
    assert r.remove("x") and not r.exists("x")


def test_unified_and_tokens(spark):
    u = R.unified({"a": spark.range(2), "b": spark.range(3)})
    assert {r["_dataset_name"]: r["count"] for r in u.groupBy("_dataset_name").count().collect()} == {"a": 2, "b": 3}
    t = R.mock_tokens(spark, 5, 10, 20, 1)
    assert t.collect() == R.mock_tokens(spark, 5, 10, 20, 1).collect()
    assert R.read_tokens(t, 1, 2).where(F.size("tokens") > 2).count() == 0
    m = W.merge_token_tables([t, t])
    assert sorted(r.doc_id for r in m.collect()) == list(range(10))


def test_replace_table(spark, tmp_path):
    path = str(tmp_path / "t")
    W.replace_table(spark.range(3), path, ["id"])
    W.replace_table(spark.range(5), path, ["id"])
    assert spark.read.parquet(path).count() == 5 and len(list(tmp_path.iterdir())) == 1
    W.write_json_lines(spark.createDataFrame([(2, "x"), (1, "y")], "b int, a string"), str(tmp_path / "j"), ["b"])
    assert [r.value for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"a":"y","b":1}', '{"a":"x","b":2}']


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("select id, id % 2 as k, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(id as int), 0) as ts, cast(id as double) as v from range(20)").write.parquet(src)
    schema = spark.read.parquet(src).schema
    q = S.windowed_counts(S.file_stream(spark, src, schema), "ts", "k", "v").writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from w").first()[0] == 20
    u = S.upsert_stream(S.file_stream(spark, src, schema), str(tmp_path / "out"), str(tmp_path / "ck"), ["k"], "ts")
    u.processAllAvailable()
    u.stop()
    assert {r.k: r.id for r in spark.read.parquet(str(tmp_path / "out/v0")).collect()} == {0: 18, 1: 19}
    b = S.bounded_queue(S.file_stream(spark, src, schema), "k", "id", "ts", 3).writeStream.format("memory").queryName("b").outputMode("update").start()
    b.processAllAvailable()
    b.stop()
    assert sorted((r.k, r.id, r.dropped) for r in spark.sql("select * from b").collect()) == [(0, 14, 7), (0, 16, 7), (0, 18, 7), (1, 15, 7), (1, 17, 7), (1, 19, 7)]
