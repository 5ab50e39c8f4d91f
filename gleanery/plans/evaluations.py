"""Queries of evaluation operators: events, line items and documents play results."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import evaluation as E
from gleanery.plans.registry import query, table


def _ev(spark, d):
    return table(spark, d, "events").withColumn("reward", F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0))


R = "CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query("agg06_pass_rates", f"SELECT round(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / count(*), 9) AS pass_at_1, round((SELECT avg(CASE WHEN m > 0 THEN 1.0::DOUBLE ELSE 0 END) FROM (SELECT user_id, max({R}) AS m FROM events GROUP BY user_id)), 9) AS pass_at_k, count(DISTINCT user_id) AS n_tasks FROM (SELECT user_id, {R} AS r FROM events)")
def agg06(spark, d):
    r = E.pass_rates(_ev(spark, d), [F.col("user_id")], "reward")
    return r.select(F.round("pass_at_1", 9).alias("pass_at_1"), F.round("pass_at_k", 9).alias("pass_at_k"), "n_tasks")


@query("agg07_source_pass_rates", f"SELECT l_returnflag AS source, round(avg(CASE WHEN l_quantity > 45 THEN 1.0::DOUBLE ELSE 0 END), 9) AS mean_reward, round((SELECT avg(x) FROM (SELECT max(CASE WHEN l_quantity > 45 THEN 1.0::DOUBLE ELSE 0 END) AS x FROM lineitem b WHERE b.l_returnflag = a.l_returnflag GROUP BY l_orderkey)), 9) AS pass_at_k FROM lineitem a GROUP BY l_returnflag")
def agg07(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("source"), (F.col("l_quantity") > 45).cast("double").alias("reward"))
    return E.source_pass_rates(rows, "source", "l_orderkey", "reward").select("source", F.round("mean_reward", 9).alias("mean_reward"), F.round("pass_at_k", 9).alias("pass_at_k"))


@query("agg08_metric_table", "SELECT l_returnflag, l_orderkey, round(avg(l_quantity), 6) AS mean_n, round(stddev_pop(l_quantity), 6) AS std_n, count(*) AS n FROM lineitem GROUP BY ALL")
def agg08(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.round(F.avg("l_quantity"), 6).alias("mean_n"), F.round(F.stddev_pop("l_quantity"), 6).alias("std_n"), F.count("*").alias("n"))


@query("agg09_expected_best", """
WITH s AS (SELECT l_orderkey, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS i, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS j, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, round(sum(v * (pow(i / n, 4) - pow((i - 1) / n, 4))), 6) AS best_at_4, round(sum(v * (pow(j / n, 4) - pow((j - 1) / n, 4))), 6) AS worst_at_4 FROM s GROUP BY l_orderkey""")
def agg09(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("v"))
    return rows.select("l_orderkey", F.round(E.expected_best(F.col("v"), 4), 6).alias("best_at_4"), F.round(E.expected_best(F.col("v"), 4, largest=False), 6).alias("worst_at_4"))


@query("agg09_bootstrap")
def agg09_bootstrap(spark, d):
    return E.bootstrap(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", 4, draws=200)


@query("agg10_majority", """
WITH v AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM v)
SELECT b.user_id, b.event_type AS majority, e.value, b.n AS votes FROM b JOIN events e ON e.event_id = b.f WHERE r = 1""")
def agg10(spark, d):
    return E.majority(table(spark, d, "events").select("user_id", "event_type", "value", "event_id"), ["user_id"], "event_type", "value", "event_id")


@query("agg11_reduce_by_name", "SELECT name, CASE WHEN name LIKE '%max%' THEN max(v) WHEN name LIKE '%min%' THEN min(v) ELSE round(avg(v), 6) END AS value FROM (SELECT CASE l_returnflag WHEN 'A' THEN 'len/max' WHEN 'N' THEN 'len/min' ELSE 'len/mean' END AS name, l_quantity AS v FROM lineitem) GROUP BY name")
def agg11(spark, d):
    name = F.when(F.col("l_returnflag") == "A", "len/max").when(F.col("l_returnflag") == "N", "len/min").otherwise("len/mean")
    return E.reduce_by_name(table(spark, d, "lineitem").select(name.alias("name"), "l_quantity"), "name", "l_quantity").select("name", F.round("value", 6).alias("value"))


@query("agg12_batch_metrics", """
SELECT avg(l_quantity) AS score_mean, max(l_quantity) AS score_max, min(l_quantity) AS score_min, round(avg(CASE WHEN l_linenumber = 7 THEN 1.0::DOUBLE ELSE 0 END), 9) AS clip_ratio,
       round(1 - var_samp(l_quantity - l_tax * 100) / (var_samp(l_quantity) + 1e-5), 6) AS explained FROM lineitem""")
def agg12(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(F.avg(q).alias("score_mean"), F.max(q).alias("score_max"), F.min(q).alias("score_min"), F.round(F.avg((F.col("l_linenumber") == 7).cast("double")), 9).alias("clip_ratio"), F.round(1 - F.var_samp(q - F.col("l_tax") * 100) / (F.var_samp(q) + 1e-5), 6).alias("explained"))


@query("agg13_agg14_throughput", "SELECT event_type, round(sum(value) * 1000 / count(*), 6) AS ms_per_token, round(count(*) / (sum(value) * 8), 9) AS throughput FROM events GROUP BY event_type")
def agg13(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") * 1000 / F.count("*"), 6).alias("ms_per_token"), F.round(F.count("*") / (F.sum("value") * 8), 9).alias("throughput"))


@query("agg19_first_row_histogram", "SELECT event_type, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1 GROUP BY event_type")
def agg19(spark, d):
    firsts = table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
    return firsts.groupBy("event_type").agg(F.count("*").alias("n"))


@query("agg20_episode_metrics", "SELECT l_orderkey, sum(r) > 0 AS correct, round(avg(r), 6) AS mean_reward FROM (SELECT l_orderkey, l_returnflag, sum(l_quantity - 25) AS r FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def agg20(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum(F.col("l_quantity") - 25).alias("r"))
    return t.groupBy("l_orderkey").agg((F.sum("r") > 0).alias("correct"), F.round(F.avg("r"), 6).alias("mean_reward"))


@query("agg21_category_accuracy", "SELECT coalesce(o_orderpriority, 'Average') AS category, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority)")
def agg21(spark, d):
    return E.category_accuracy(table(spark, d, "orders"), "o_orderpriority", F.col("o_orderstatus") == "F")


@query("agg04_timing_summary", """
WITH s AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)
SELECT event_type, len(v) AS n, round(list_sum(v), 4) AS total, round(list_avg(v), 6) AS mean, v[1] AS least, v[-1] AS largest, v[len(v) // 2 + 1] AS p50 FROM s""")
def agg04(spark, d):
    s = E.timing_summary(table(spark, d, "events"), "event_type", "value")
    return s.select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "largest", "p50")


@query("agg05_accuracy_report", "SELECT coalesce(100 * avg(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE event_type <> 'error'), 0) AS accuracy, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events")
def agg05(spark, d):
    ok = F.when(F.col("event_type") != "error", (F.col("event_type") == "purchase").cast("double"))
    return table(spark, d, "events").agg(F.coalesce(100 * F.avg(ok), F.lit(0.0)).alias("accuracy"), F.count(ok).alias("n"))


@query("agg24_balance_log", "SELECT min(s) AS least, max(s) AS largest, round(avg(s), 6) AS mean FROM (SELECT l_suppkey, sum(l_quantity) AS s FROM lineitem GROUP BY l_suppkey)")
def agg24(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("s"))
    return s.agg(F.min("s").alias("least"), F.max("s").alias("largest"), F.round(F.avg("s"), 6).alias("mean"))


@query("evl01_first_duplicate", "SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r = 1")
def evl01(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"))
    return E.first_of_duplicates(rows, "l_orderkey", "at")


@query("evl07_containment", "SELECT lang, CAST(sum(CASE WHEN contains(lower(text), 'en') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'ou') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'zz') THEN 1 ELSE 0 END) AS BIGINT) AS score FROM documents GROUP BY lang")
def evl07(spark, d):
    rows = table(spark, d, "documents").select("lang", "text").withColumn("golds", F.array(F.lit("EN"), F.lit("ou"), F.lit("zz")))
    return E.containment(rows, "lang", "text", "golds")


@query("evl08_decimal_answer", r"SELECT l_orderkey, l_partkey, l_suppkey, regexp_replace(regexp_replace(regexp_replace(t, '(\.\d{2})\d+$', '\1'), '(\.\d*?)0+$', '\1'), '\.$', '') AS answer FROM (SELECT *, CAST(CAST(l_extendedprice / 7 AS DECIMAL(18, 4)) AS VARCHAR) AS t FROM lineitem)")
def evl08(spark, d):
    t = F.concat((F.col("l_extendedprice") / 7).cast("decimal(18,4)").cast("string"), F.lit("%."))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", E.decimal_answer(t).alias("answer"))


@query("evl09_option_match", "SELECT event_id, contains(g, a) OR contains(a, g) AS correct, (contains(g, a) OR contains(a, g)) AND a <> '' AS correct_strict FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS a, CASE WHEN event_type = 'view' THEN 'views' ELSE 'click' END AS g FROM events)")
def evl09(spark, d):
    a = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.upper("event_type"), F.lit(". it is")))
    g = F.when(F.col("event_type") == "view", "views it").otherwise("click.")
    return table(spark, d, "events").select("event_id", E.option_match(a, g).alias("correct"), E.option_match(a, g, strict=True).alias("correct_strict"))


@query("evl11_choice", "SELECT event_id, CASE event_type WHEN 'click' THEN 'B' WHEN 'view' THEN 'C' ELSE 'A' END AS choice FROM events")
def evl11(spark, d):
    r = F.when(F.col("event_type") == "click", "first (A), no: (B) it is").when(F.col("event_type") == "view", "I say C or so").otherwise("nothing of use")
    return table(spark, d, "events").select("event_id", E.choice(r, ["A", "B", "C", "D"]).alias("choice"))


@query("evl14_domain_rollup", """
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Overall' ELSE o_orderpriority END AS domain, CASE WHEN grouping(o_orderstatus) = 1 THEN '*' ELSE o_orderstatus END AS category,
       round(avg(CASE WHEN o_totalprice > 100000 THEN 1.0::DOUBLE ELSE 0 END), 4) AS accuracy, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def evl14(spark, d):
    return E.domain_accuracy(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 100000)


@query("evl17_offline_scores", "SELECT l_returnflag, round(avg(m), 6) AS score FROM (SELECT l_returnflag, l_orderkey, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) GROUP BY l_returnflag")
def evl17(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_returnflag", "l_orderkey").agg(F.avg("l_quantity").alias("m"))
    return m.groupBy("l_returnflag").agg(F.round(F.avg("m"), 6).alias("score"))
