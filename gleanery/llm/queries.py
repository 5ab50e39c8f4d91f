"""The queries of this package: one per operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.llm import chat_format, hamming_topk, licenses, mixing, ngram_join, order_minhash, quality_fm, sentencepiece_codec, sharding, token_files


PROBE = "\\### Assistant: </turn> ok"


def chat_log(rows: DataFrame) -> DataFrame:
    """A log (conv_id, seq, turn, event, role, text) whose fold is ``rows`` (conv_id, turn, role, text).

    A turn's text comes, by its number, in two pieces; as a draft and its edit;
    or as a draft that was answered, then regenerated, which drops the answer.
    Rows that share a turn, or have none, are whole messages, as an edit would
    replace all of a turn.
    """
    shared = rows.groupBy(F.col("conv_id").alias("_c"), F.col("turn").alias("_t")).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    shared = C.sized(C.materialize(shared, "chat-shared")).withColumn("_shared", F.lit(True))
    rows = rows.join(shared, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")), "left")
    kind = F.when(F.col("_shared") | F.col("conv_id").isNull() | F.col("turn").isNull(), -1).otherwise(F.pmod("turn", F.lit(3)))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    event = lambda k, name, said, turn=F.col("turn"): F.struct((F.col("turn") * 4 + k).alias("seq"), turn.alias("turn"), F.lit(name).alias("event"), F.col("role").alias("role"), said.alias("text"))
    draft = F.lit("a draft </turn>")
    events = (
        F.when(kind == 0, F.array(event(1, "delta", F.substring(text, half + 1, F.length(text))), event(0, "message", F.left(text, half))))
        .when(kind == 1, F.array(event(1, "edit", text), event(0, "message", draft)))
        .when(kind == 2, F.array(event(2, "regenerate", text), event(1, "message", draft, F.col("turn") + 1), event(0, "message", draft)))
        .otherwise(F.array(event(0, "message", text)))
    )
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = chat_format.format_chats(chat_log(rows.unionAll(probe)))
    # what follows reads the output alone
    read = done.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("blocks")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "formatted")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", F.sha2("formatted", 256).alias("formatted_sha256"))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, '<turn ' || replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g') || '>' || chr(10)
            || replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g') || '</turn>' || chr(10) AS done
  FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg(done, '' ORDER BY turn NULLS FIRST, role, text) AS formatted
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       length(formatted) AS formatted_chars, sha256(formatted) AS formatted_sha256
FROM g
"""


#: Every row whose id this divides is a query.
QUERY_STEP = 100


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.top_k(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0, k=10, bits=64)


OP2_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END) AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.code, c.code), lambda z: abs(z[1] - z[2]))) AS INT) AS distance
  FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write(C.table(spark, sf_dir, "documents"), model="word_bpe_49k.json", end_id=1)
    return token_files.read(spark, path, digest=True)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(C.table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(C.table(spark, sf_dir, "documents"))


#: The same by sums: of source targets by caps in order of size to weight, and of a document's place in its source's shuffled stream.
OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('11:' || doc_id), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight
  FROM d GROUP BY source),
c AS (
  SELECT *, 3 * sum(source_size) OVER () AS whole,
         (3 * sum(source_size) OVER () - 2 * coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
         >= 4 * source_size * sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM s),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
              ELSE CAST(whole - 2 * coalesce(sum(CASE WHEN capped THEN 2 * source_size END) OVER (), 0) AS DOUBLE) * weight / (2 * sum(CASE WHEN NOT capped THEN weight END) OVER ()) END AS target
  FROM c),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS take,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(least(size, greatest(take - place, 0)) + least(size, greatest(take - source_size - place, 0)) AS BIGINT) AS taken
FROM p
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(C.table(spark, sf_dir, "documents"), n_shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_decode_digest(C.table(spark, sf_dir, "documents"))


#: Rows of this remainder are held out: their labels are never learnt from.
FOLDS, HELD_FOLD = 5, 0
#: Metadata that the classifier may read; id, language and source never.
QUALITY_META = ("n_chars",)
QUALITY_THRESHOLD = 0.3


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_FOLD, F.lit(False))


def quality_scores(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, keep: tuple[str, ...], out_col: str = "score") -> DataFrame:
    model = quality_fm.train(all_docs, labels, "quality", ~_held_out(), meta_cols=QUALITY_META)
    return quality_fm.score(docs, model, keep, meta_cols=QUALITY_META, out_col=out_col)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(C.table(spark, sf_dir, "documents")).drop("spans")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(C.table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = quality_scores(docs, docs, C.table(spark, sf_dir, "labels"), ("doc_id",))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_token_files": op3_token_files,
    "op4_order_minhash": op4_order_minhash,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_quality": op10_quality,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op2_hamming_topk": OP2_SQL, "op5_mixing": OP5_SQL}
