"""A corpus pipeline: quality, near-duplicates, mixture, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir),
where docs has the columns of ``documents``, and works on every row that the
stage before kept. All but the last return these columns. ``run`` applies the
stages to ``documents``, each written as Parquet into the shared folder and
read again as the next one's docs.

1. quality: a factorisation machine, fitted on labelled rows of ``docs`` outside
   the held-out fold; documents that it rejects go.
2. near_duplicates: groups of documents linked by five-word shingle sets of
   Jaccard likeness 0.8 or more; of each group the document with the smallest id
   stays. Rows that repeat one id count as one document. Texts without words
   have no group and stay.
3. mixture: sources at their target weights. A document stands in the result as
   often as the mix takes it, to the nearest whole number (0, 1 or 2 times). One
   without words (a null, empty or blank text) takes nothing from any source's
   share and stands in it once.
4. tokens: SentencePiece ids and the text they decode to, as digests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.llm import mixing, ngram_join, queries, sentencepiece_codec


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold."""
    labels = C.table(C.small_batches(spark), sf_dir, "labels")
    (score,) = C.unused(docs, "score")
    scored = queries.quality_scores(docs, docs, labels, tuple(docs.columns), score)
    return scored.where(F.col(score) >= queries.QUALITY_THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group."""
    C.small_batches(spark)
    groups = ngram_join.jaccard_groups(docs, n=5, percent=80)
    gone = C.materialize(groups.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    kept = docs.join(C.sized(gone), "doc_id", "left_anti").select(*docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    # of rows that repeat an id the first one, by text and then by the whole row
    (nth,) = C.unused(docs, "nth")
    first = Window.partitionBy("doc_id").orderBy("text", F.to_json(F.struct(*docs.columns)))
    again = kept.join(twice, "doc_id", "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).select(*docs.columns)
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionAll(again)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one without words, of which there is nothing to take, once."""
    key, times, copy = C.unused(docs, "key", "times", "copy")
    n = F.when(F.col("size") == 0, 1).otherwise(F.round(F.try_divide("taken", "size")).cast("int"))
    taken = mixing.taken(docs).groupBy(F.col("doc_id").alias(key)).agg(F.max(n).alias(times)).where(F.col(times) > 0)
    taken = C.materialize(taken, "pipeline-mix")
    out = docs.join(C.sized(taken), F.col("doc_id").eqNullSafe(F.col(key)))
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    C.small_batches(spark)
    return sentencepiece_codec.encode_decode_digest(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
