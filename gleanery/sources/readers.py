"""Scans: files of any supported format, tolerant JSON, keyed JSON lines, registries, token tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = {"json": "json", "jsonl": "json", "csv": "csv", "parquet": "parquet", "arrow": "arrow", "txt": "text", "orc": "orc"}


def read_files(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Rows of a file or folder by its extension; a ``.json`` file may be one array, other JSON is a line a row."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise ValueError(f"no reader for {path}")
    r = spark.read.schema(schema) if schema is not None else spark.read
    if kind == "csv":
        return r.option("header", True).csv(path)
    if kind == "json":
        return r.option("multiLine", True).json(path)
    return r.format(FORMATS[kind]).load(path)


def _objects(text: str) -> Iterator[dict]:
    """Objects one after the other, parted by white space."""
    decoder, at = json.JSONDecoder(), 0
    while at < len(text):
        while at < len(text) and text[at].isspace():
            at += 1
        if at < len(text):
            value, at = decoder.raw_decode(text, at)
            if not isinstance(value, dict):
                raise ValueError("a record is no object")
            yield value


def read_tolerant_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; files with a line that doesn't parse are read anew as objects that may span lines. One row per file is held by a task."""
    files = spark.read.text(path, wholetext=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["value"]:
                try:
                    rows = [json.loads(line) for line in text.splitlines() if line.strip()]
                    if any(not isinstance(r, dict) for r in rows):
                        raise ValueError("a record is no object")
                except json.JSONDecodeError:
                    rows = list(_objects(text))
                out += [json.dumps(r) for r in rows]
            yield pd.DataFrame({"value": out})

    return files.mapInPandas(parse, "value string").select(F.from_json("value", schema).alias("r")).select("r.*")


def read_keyed_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """JSON lines with a key: blank lines are skipped, of equal keys the last line stays, a missing key is an error. The line order is Spark's row index of the file."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())).where(F.trim("value") != "")
    rows = lines.select("_at", F.from_json("value", schema).alias("r"))
    name = F.col(f"r.{key}")
    rows = rows.withColumn("_k", F.when(name.isNull(), F.raise_error(F.lit(f"a line has no {key}"))).otherwise(name))
    return rows.groupBy("_k").agg(F.max_by("r", "_at").alias("r")).select("r.*")


def read_tokens(table: DataFrame, offset: int = 0, length: int | None = None, tokens: str = "tokens") -> DataFrame:
    """Documents' tokens, or a range of each."""
    n = F.lit(length) if length is not None else F.size(tokens)
    return table.withColumn(tokens, F.slice(tokens, F.lit(offset + 1), n))


def mock_tokens(spark: SparkSession, n: int, vocab: int, most: int, seed: int = 0) -> DataFrame:
    """doc_id and tokens of ``n`` synthetic documents, the same for the same seed."""
    size = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most)) + 1
    return spark.range(n).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), size), lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed + 1)), F.lit(vocab)).cast("int")).alias("tokens"))


@dataclass
class DatasetSpec:
    """Where a named data set lies and how its columns are called."""

    path: str
    formatting: str = "instruction"
    columns: dict[str, str] = field(default_factory=dict)
    samples: int | None = None


class Registry:
    """Named data sets with splits: a small JSON file beside the tables' folders, read and written by the driver through Spark."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str, split: str) -> str:
        return f"{self.root}/{name}/{split}.parquet"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def register(self, name: str, df: DataFrame, split: str = "default") -> DataFrame:
        """Write the rows, and beside them the form that trainers read: a prompt placeholder, a rule reward without truth, the row as extra."""
        df.write.mode("overwrite").parquet(self._path(name, split))
        stored = self.spark.read.parquet(self._path(name, split))
        reward = F.struct(F.lit("rule").alias("style"), F.lit(None).cast("string").alias("ground_truth"))
        prompt = F.array(F.struct(F.lit("user").alias("role"), F.lit("placeholder").alias("content")))
        stored.select(prompt.alias("prompt"), reward.alias("reward_model"), F.struct("*").alias("extra_info")).write.mode("overwrite").parquet(self._path(name, f"{split}_training"))
        return stored

    def load(self, name: str, split: str = "default") -> DataFrame | None:
        return self.spark.read.parquet(self._path(name, split)) if self._exists(self._path(name, split)) else None

    def exists(self, name: str) -> bool:
        return self._exists(f"{self.root}/{name}")

    def names(self) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []

    def remove(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def unified(parts: dict[str, DataFrame]) -> DataFrame:
    """One or many named data sets as one, each row with its set's name; all must be batch, or all streams."""
    if len({df.isStreaming for df in parts.values()}) > 1:
        raise ValueError("batch and streaming data sets can't be mixed")
    named = [df.withColumn("_dataset_name", F.lit(n)) for n, df in parts.items()]
    out = named[0]
    for df in named[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sampled(df: DataFrame, n: int, seed: int, *ids: str) -> DataFrame:
    """``n`` rows in the order of a seeded digest of their ids (a sample is the feature)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), *ids)), *ids).limit(n)


def sub_documents(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= most).drop("_r")
