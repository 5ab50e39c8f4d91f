"""Queries of training-set operators over documents, line items, orders and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.operators import datasets as D
from gleanery.plans.registry import query, table

WORDS = r"CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT)"


def _docs(spark, d):
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return table(spark, d, "documents").select("doc_id", "lang", "source", n.alias("n_words"))


@query("set01_concat", "SELECT 'orders' AS part, o_orderkey AS key FROM orders UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'customer', c_custkey FROM customer")
def set01(spark, d):
    parts = [("orders", "o_orderkey"), ("part", "p_partkey"), ("customer", "c_custkey")]
    return D.concat([table(spark, d, t).select(F.lit(t).alias("part"), F.col(k).alias("key")) for t, k in parts])


def _three(spark, d):
    """Documents of three languages as datasets 0, 1, 2, numbered by id."""
    name = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2)
    docs = table(spark, d, "documents").select("doc_id", name.alias("ds")).where("ds is not null")
    return D.position_in_group(docs, ["ds"], ["doc_id"], "row")


_THREE = "SELECT doc_id, ds, row_number() OVER (PARTITION BY ds ORDER BY doc_id) - 1 AS row FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS ds FROM documents) WHERE ds IS NOT NULL"


@query("set02_interleave_first", f"""
WITH t AS ({_THREE}), z AS (SELECT ds, count(*) AS n FROM t GROUP BY ds), s AS (SELECT min(n) AS short, (SELECT min(ds) FROM z WHERE n = (SELECT min(n) FROM z)) AS ends FROM z)
SELECT doc_id, row_number() OVER (ORDER BY row, ds) - 1 AS place FROM t, s WHERE row < short OR (row = short AND ds < ends)""")
def set02(spark, d):
    rows = D.interleave(_three(spark, d), "ds", "row", 3, "first")
    return D.with_position(rows.withColumn("k", F.col("place")["_round"] * 3 + F.col("place")["ds"]), ["k"], "at").select("doc_id", F.col("at").alias("place"))


@query("set02_interleave_once", f"WITH t AS ({_THREE}) SELECT doc_id, row_number() OVER (ORDER BY row, ds) - 1 AS place FROM t")
def set02_once(spark, d):
    rows = D.interleave(_three(spark, d), "ds", "row", 3, "once")
    return D.with_position(rows.withColumn("k", F.col("place")["_round"] * 3 + F.col("place")["ds"]), ["k"], "at").select("doc_id", F.col("at").alias("place"))


@query("set02_interleave_all", f"WITH t AS ({_THREE}), z AS (SELECT *, count(*) OVER (PARTITION BY ds) AS n FROM t), m AS (SELECT max(n) AS most FROM z) SELECT doc_id, row + k * n AS round FROM z, m, range(0, 10000) r(k) WHERE row + k * n < most")
def set02_all(spark, d):
    return D.interleave(_three(spark, d), "ds", "row", 3, "all").select("doc_id", F.col("place")["_round"].cast("long").alias("round"))


@query("set03_paced_blend", f"SELECT doc_id, (row + 0.5::DOUBLE) / CASE ds WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.25::DOUBLE ELSE 0.125::DOUBLE END AS pace FROM ({_THREE})")
def set03(spark, d):
    w = F.when(F.col("ds") == 0, 0.5).when(F.col("ds") == 1, 0.25).otherwise(0.125)
    return D.paced(_three(spark, d).withColumn("w", w), "row", "w").select("doc_id", "pace")


@query("set06_repeat", "SELECT p_partkey, copy, row_number() OVER (ORDER BY p_partkey, copy) - 1 AS place FROM part, range(0, 3) r(copy)")
def set06(spark, d):
    rows = D.repeat(table(spark, d, "part").select("p_partkey"), 3, "p_partkey")
    return D.with_position(rows, ["p_partkey", "copy"], "at").select("p_partkey", F.col("copy").cast("long").alias("copy"), F.col("at").alias("place"))


@query("set07_repeat_each", "SELECT l_orderkey, l_partkey, copy FROM lineitem, range(0, 7) r(copy) WHERE copy < l_linenumber - 1")
def set07(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_linenumber") - 1).alias("times"))
    return D.repeat_each(rows, "times").select("l_orderkey", "l_partkey", F.col("copy").cast("long").alias("copy"))


@query("set08_unfold", "SELECT vec_id, part, list_sum(embedding[part * 16 + 1 : part * 16 + 16]) > 0 AS positive, len(embedding[part * 16 + 1 : part * 16 + 16]) AS n FROM embeddings, range(0, 4) r(part)")
def set08(spark, d):
    rows = D.unfold(table(spark, d, "embeddings").select("vec_id", "embedding"), ["embedding"], 4)
    total = F.aggregate("embedding", F.lit(0.0).cast("float"), lambda a, v: a + v)
    return rows.select("vec_id", F.col("part").cast("long").alias("part"), (total > 0).alias("positive"), F.size("embedding").cast("long").alias("n"))


@query("set10_pad_to_divisor", "SELECT c_custkey, false AS is_pad FROM customer UNION ALL SELECT c_custkey, true FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r <= (64 - (SELECT count(*) FROM customer) % 64) % 64")
def set10(spark, d):
    return D.pad_to_divisor(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 64)


@query("srt08_srt09_shuffled_split", "SELECT doc_id, CASE WHEN p >= CAST(floor((SELECT count(*) FROM documents) * 0.9) AS BIGINT) THEN 1 ELSE 0 END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || substr(md5('42:' || doc_id), 1, 13) AS BIGINT), doc_id) - 1 AS p FROM documents)")
def srt09(spark, d):
    return D.exact_split(table(spark, d, "documents").select("doc_id"), 42, [0.9, 0.1], "doc_id")


@query("srt13_srt05_first_rows", "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r BETWEEN 21 AND 40")
def srt05(spark, d):
    """The second page of twenty (the limit is the feature): a top-k of two pages, then the first one goes."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(40)
    return rows.withColumn("r", F.row_number().over(Window.orderBy(F.desc("o_orderdate"), "o_orderkey"))).where("r > 20").drop("r")


@query("srt15_srt16_packing")
def srt15(spark, d):
    """Documents packed into 4096 words, in batches of about 1000 by a digest of their ids."""
    docs = _docs(spark, d)
    n = max(1, docs.count() // 1000)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(n))
    return D.pack(docs.select(batch.alias("batch"), "doc_id", "n_words"), "batch", "doc_id", "n_words", 4096)


@query("srt17_concat_and_chunk", f"""
WITH o AS (SELECT doc_id, {WORDS} AS n FROM documents), s AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM o)
SELECT doc_id, CAST(st AS BIGINT) AS start, CAST(st // 512 AS BIGINT) AS first_block, CAST((st + n - 1) // 512 AS BIGINT) AS last_block FROM s WHERE n > 0""")
def srt17(spark, d):
    o = D.offsets(_docs(spark, d).where("n_words > 0"), ["doc_id"], "n_words")
    return o.select("doc_id", "start", F.floor(F.col("start") / 512).alias("first_block"), F.floor((F.col("start") + F.col("n_words") - 1) / 512).alias("last_block"))


@query("srt18_srt20_micro_batches")
def srt20(spark, d):
    docs = _docs(spark, d)
    n = max(1, docs.count() // 500)
    return D.micro_batches(docs.where("n_words > 0").select(F.pmod(F.xxhash64("doc_id"), F.lit(n)).alias("batch"), "doc_id", "n_words"), "batch", "doc_id", "n_words", 8192)


@query("srt21_chunks_of_rows", "SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS chunk FROM customer")
def srt21(spark, d):
    return D.chunk(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 100)


@query("win34_sample_index", f"""
WITH o AS (SELECT doc_id, {WORDS} AS n FROM documents), s AS (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM o),
i AS (SELECT CAST(k AS BIGINT) AS sample FROM range(0, (SELECT CAST(sum(n) AS BIGINT) FROM o) // 256 + 1) r(k))
SELECT sample, doc_id, CAST(sample * 256 - st AS BIGINT) AS "offset" FROM i JOIN s ON sample * 256 >= st AND sample * 256 < st + n""")
def win34(spark, d):
    return D.sample_index(_docs(spark, d), ["doc_id"], "n_words", 256).select("sample", "doc_id", "offset")


@query("win35_agg25_chunks", f"SELECT doc_id, CAST(b AS INT) AS begin, CAST(least(b + 64, n) AS INT) AS stop FROM (SELECT doc_id, n, unnest(range(0, n, 64)) AS b FROM (SELECT doc_id, {WORDS} AS n FROM documents))")
def win35(spark, d):
    return D.chunks(_docs(spark, d), "n_words", 64).select("doc_id", "begin", "stop")


@query("win36_chunk_offsets", f"SELECT doc_id, CAST(coalesce(sum(c) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_chunk FROM (SELECT doc_id, (({WORDS}) + 63) // 64 AS c FROM documents)")
def win36(spark, d):
    docs = _docs(spark, d).withColumn("c", F.floor((F.col("n_words") + 63) / 64))
    return D.offsets(docs, ["doc_id"], "c").select("doc_id", F.col("start").alias("first_chunk"))


@query("agg23_length_cdf", f"""
WITH h AS (SELECT (({WORDS}) // 100) * 100 AS bucket, count(*) AS n FROM documents GROUP BY 1)
SELECT bucket, n, CAST(sum(n) OVER (ORDER BY bucket) AS BIGINT) AS cum, round(100.0::DOUBLE * sum(n) OVER (ORDER BY bucket) / sum(n) OVER (), 6) AS percent FROM h""")
def agg23(spark, d):
    h = _docs(spark, d).groupBy((F.floor(F.col("n_words") / 100) * 100).alias("bucket")).agg(F.count("*").alias("n"))
    run = Window.orderBy("bucket")  # a row for each length class
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return h.select("bucket", "n", F.sum("n").over(run).alias("cum"), F.round(100.0 * F.sum("n").over(run) / F.sum("n").over(whole), 6).alias("percent"))


@query("agg26_epochs", f"SELECT CAST(sum(n) AS BIGINT) AS tokens, CAST(ceil((100000 * 256 + 1) / sum(n)) AS BIGINT) AS epochs FROM (SELECT {WORDS} AS n FROM documents)")
def agg26(spark, d):
    return _docs(spark, d).agg(F.sum("n_words").alias("tokens"), F.ceil((100_000 * 256 + 1) / F.sum("n_words")).alias("epochs"))


@query("prj10_slice", "SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos >= 100 AND pos < 5000 AND (pos - 100) % 7 = 0")
def prj10(spark, d):
    rows = D.with_position(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return rows.where((F.col("pos") >= 100) & (F.col("pos") < 5000) & ((F.col("pos") - 100) % 7 == 0))


@query("prj19_numbered_rows", "SELECT row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id, lang, 'image_' || doc_id || ': 1 ' || chr(10) || ' Question: ' || text AS question FROM documents")
def prj19(spark, d):
    docs = D.position_in_group(table(spark, d, "documents").select("doc_id", "lang", "text"), ["lang"], ["doc_id"], "id")
    return docs.select("id", "lang", F.concat(F.lit("image_"), F.col("doc_id").cast("string"), F.lit(": 1 \n Question: "), "text").alias("question"))


@query("prj24_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def prj24(spark, d):
    return table(spark, d, "orders").where("o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'").select("o_orderkey")


@query("prj25_overlong_filter", f"SELECT doc_id FROM documents WHERE {WORDS} <= 400")
def prj25(spark, d):
    return _docs(spark, d).where("n_words <= 400").select("doc_id")


@query("joi08_column_union", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def joi08(spark, d):
    """Two projections of one table put side by side by row id, after a check that shared columns agree."""
    left = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    right = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("_again"), "o_orderstatus")
    both = left.join(right, "o_orderkey")
    same = F.when(~F.col("o_totalprice").eqNullSafe(F.col("_again")), F.raise_error(F.lit("columns differ"))).otherwise(F.col("o_totalprice"))
    return both.select("o_orderkey", same.cast("double").alias("o_totalprice"), "o_orderstatus")


@query("set11_seen_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set11(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("fnc13_reset_positions", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, seg ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM (SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM lineitem)")
def fnc13(spark, d):
    """Positions that start anew after each end mark."""
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy("l_orderkey").orderBy(*order)
    rows = table(spark, d, "lineitem").select("l_orderkey", *order, "l_returnflag")
    rows = rows.withColumn("seg", F.coalesce(F.sum((F.col("l_returnflag") == "R").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.select("l_orderkey", *order, (F.row_number().over(Window.partitionBy("l_orderkey", "seg").orderBy(*order)) - 1).cast("long").alias("pos"))


@query("ltl06_ltl12_replicate", "SELECT item_id, copy FROM benchmark, range(0, 20) r(copy)")
def ltl06(spark, d):
    return D.repeat(table(spark, d, "benchmark").select("item_id"), 20, "item_id").select("item_id", F.col("copy").cast("long").alias("copy"))
