"""Queries of group statistics, advantages, rejection and token arrays over line items: a group is an order, a score its row's quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import arrays as A
from gleanery.operators import advantages as V
from gleanery.plans.registry import query, table

GROUP, SCORE = ["l_orderkey"], "l_quantity"
W = "PARTITION BY l_orderkey"


def _items(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", "l_tax", "l_shipdate").withColumn("line", F.struct("l_linenumber", "l_partkey", "l_suppkey"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", "l_linenumber", F.round("advantage", 6).alias("advantage"))


def _sql(expr: str, more: str = "") -> str:
    return f"SELECT l_orderkey, l_linenumber, round({expr}, 6) AS advantage FROM (SELECT *, count(*) OVER ({W}) AS n, avg(l_quantity) OVER ({W}) AS m, coalesce(stddev_samp(l_quantity) OVER ({W}), 0) AS sd, var_samp(l_quantity) OVER ({W}) AS v, sum(l_quantity) OVER ({W}) AS s{more} FROM lineitem)"


FLAGSHIP_SQL = f"""
WITH g AS (SELECT *, bool_and(l_returnflag = 'R') OVER ({W}) AS a, bool_or(l_returnflag = 'R') OVER ({W}) AS o,
                  count(*) OVER ({W}) AS n, avg(l_quantity) OVER ({W}) AS m, coalesce(stddev_samp(l_quantity) OVER ({W}), 0) AS sd FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN n > 1 THEN (l_quantity - m) / (sd + 1e-6) ELSE l_quantity / (1 + 1e-6) END, 6) AS advantage FROM g WHERE NOT a AND o
"""


@query("win01_agg18_joi13_rejected_advantage", FLAGSHIP_SQL)
def flagship(spark, d):
    """Group-relative advantages of the orders that are neither all returned nor not at all: one shuffle for both windows."""
    rows = V.reject_uniform(_items(spark, d), GROUP, F.col("l_returnflag") == "R")
    return _out(V.advantage(rows, "grpo", GROUP, SCORE))


@query("win01_group_advantage", _sql("CASE WHEN n > 1 THEN (l_quantity - m) / (sd + 1e-6) ELSE l_quantity / (1 + 1e-6) END"))
def win01(spark, d):
    return _out(V.advantage(_items(spark, d), "grpo", GROUP, SCORE))


@query("win01_group_advantage_without_deviation", _sql("CASE WHEN n > 1 THEN l_quantity - m ELSE l_quantity END"))
def win01_mean(spark, d):
    return _out(V.advantage(_items(spark, d), "grpo", GROUP, SCORE, by_std=False))


@query("win02_group_advantage_vectorised", _sql("CASE WHEN n > 1 THEN (l_quantity - m) / (sqrt(greatest(v, 1e-6)) + 1e-6) ELSE l_quantity / (1 + 1e-6) END"))
def win02(spark, d):
    return _out(V.advantage(_items(spark, d), "grpo_vectorised", GROUP, SCORE))


@query("win03_best_of_group", _sql("CASE WHEN r = 1 AND n > 1 THEN (l_quantity - s2) / (sd + 1e-6) ELSE 0.0 END", f", row_number() OVER ({W} ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS r, lead(l_quantity) OVER ({W} ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS s2"))
def win03(spark, d):
    return _out(V.advantage(_items(spark, d), "grpo_best", GROUP, SCORE, row=["line"]))


@query("win04_leave_one_out", _sql("CASE WHEN n > 1 THEN l_quantity * n / (n - 1) - m * n / (n - 1) ELSE l_quantity END"))
def win04(spark, d):
    return _out(V.advantage(_items(spark, d), "rloo", GROUP, SCORE))


@query("win05_leave_one_out_vectorised", _sql("CASE WHEN n > 1 THEN (n * l_quantity - s) / (n - 1) ELSE 0.0 END"))
def win05(spark, d):
    return _out(V.advantage(_items(spark, d), "rloo_vectorised", GROUP, SCORE))


@query("win06_baseline_whitened", f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity - CASE WHEN count(*) OVER ({W}) > 1 THEN avg(l_quantity) OVER ({W}) ELSE 0 END AS c FROM lineitem),
m AS (SELECT sum(l_linenumber) AS n, sum(c * l_linenumber) AS s, sum(c * c * l_linenumber) AS q FROM c)
SELECT l_orderkey, l_linenumber, round((c - s / n) / sqrt((q - s * s / n) / (n - 1) + 1e-8), 6) AS advantage FROM c, m""")
def win06(spark, d):
    return _out(V.advantage(_items(spark, d), "baseline_whitened", GROUP, SCORE, length="l_linenumber"))


@query("win08_length_weighted_baseline", _sql("l_quantity - CASE WHEN n > 1 THEN ls / l ELSE 0 END", f", sum(l_linenumber * l_quantity) OVER ({W}) AS ls, sum(l_linenumber) OVER ({W}) AS l"))
def win08(spark, d):
    return _out(V.advantage(_items(spark, d), "length_baseline", GROUP, SCORE, length="l_linenumber"))


@query("win10_policy_gradient", _sql("(SELECT count(*) / greatest(count(*) FILTER (WHERE l_quantity <> 0), 1) FROM lineitem) * (l_quantity - CASE WHEN n > 1 THEN m ELSE 0 END)"))
def win10(spark, d):
    return _out(V.advantage(_items(spark, d), "policy_gradient", GROUP, SCORE))


@query("win12_whitening", """
WITH m AS (SELECT count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - s / n) / sqrt((q - s * s / n) / (n - 1) + 1e-8), 6) AS whitened FROM lineitem, m""")
def win12(spark, d):
    df = V.whiten(_items(spark, d).withColumn("one", F.lit(1)), SCORE, "one")
    return df.select("l_orderkey", "l_linenumber", F.round("whitened", 6).alias("whitened"))


@query("win16_one_sided_clamp", _sql("CASE WHEN l_returnflag = 'A' THEN greatest(a, 0.0) ELSE a END").replace("FROM (SELECT *,", "FROM (SELECT *, CASE WHEN n > 1 THEN (l_quantity - m) / (sd + 1e-6) ELSE l_quantity / (1 + 1e-6) END AS a FROM (SELECT *,") + ")")
def win16(spark, d):
    return _out(V.one_sided_clamp(V.advantage(_items(spark, d), "grpo", GROUP, SCORE), F.col("l_returnflag") == "A"))


@query("agg15_group_mean_deviation", f"""
SELECT l_orderkey, count(*) AS n, round(CASE WHEN count(*) > 1 THEN avg(l_quantity) ELSE 0 END, 6) AS mean,
       round(CASE WHEN count(*) > 1 THEN sqrt(greatest(var_samp(l_quantity), 1e-6)) ELSE 1 END, 6) AS deviation FROM lineitem GROUP BY l_orderkey""")
def agg15(spark, d):
    n = F.count("*")
    return _items(spark, d).groupBy("l_orderkey").agg(n.alias("n"), F.round(F.when(n > 1, F.avg(SCORE)).otherwise(0.0), 6).alias("mean"), F.round(F.when(n > 1, F.sqrt(F.greatest(F.var_samp(SCORE), F.lit(1e-6)))).otherwise(1.0), 6).alias("deviation"))


@query("agg18_solve_status", "SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 'all' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'none' END AS status FROM lineitem GROUP BY l_orderkey")
def agg18(spark, d):
    return V.solve_status(_items(spark, d), GROUP, F.col("l_returnflag") == "R")


@query("srt24_varied_groups", f"SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, max(l_quantity) OVER ({W}) > min(l_quantity) OVER ({W}) OR count(*) OVER ({W}) = 1 AS k FROM lineitem) WHERE k")
def srt24(spark, d):
    return V.keep_varied(_items(spark, d), GROUP, SCORE).select("l_orderkey", "l_linenumber", "l_quantity")


@query("srt23_rejection_sampling", """
WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT bool_and(l_returnflag = 'R') AND bool_or(l_returnflag = 'R')),
k AS (SELECT l_orderkey FROM g ORDER BY md5(CAST(l_orderkey AS VARCHAR)), l_orderkey LIMIT 256)
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem JOIN k USING (l_orderkey)""")
def srt23(spark, d):
    """Partly solved groups, a batch of 256 of them in the order of a seeded digest, with all their rows."""
    return V_sample(_items(spark, d), 256).select("l_orderkey", "l_linenumber", "l_quantity")


def V_sample(rows: DataFrame, batch: int) -> DataFrame:
    partial = V.solve_status(rows, GROUP, F.col("l_returnflag") == "R").where("status = 'partial'")
    chosen = partial.orderBy(F.md5(F.col("l_orderkey").cast("string")), "l_orderkey").limit(batch).select("l_orderkey")
    return rows.join(F.broadcast(chosen), "l_orderkey", "left_semi")  # ``batch`` ids


def _sequences(spark, d) -> DataFrame:
    """An order as a token sequence: rewards, values and a mask, in line order."""
    rows = F.array_sort(F.collect_list(F.struct("line", F.col("l_quantity").alias("r"), (F.col("l_tax") * 100).alias("v"), (F.col("l_returnflag") != "R").cast("int").alias("m"))))
    s = _items(spark, d).groupBy("l_orderkey").agg(rows.alias("t"))
    return s.select("l_orderkey", F.transform("t", lambda x: x["r"]).alias("r"), F.transform("t", lambda x: x["v"]).alias("v"), F.transform("t", lambda x: x["m"]).alias("m"))


@query("agg16_masked_moments", """
SELECT l_orderkey, coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0) AS masked_sum,
       round(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0) / (count(*) FILTER (WHERE l_returnflag <> 'R') + 1e-8), 4) AS masked_mean,
       round(var_samp(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 4) AS masked_var FROM lineitem GROUP BY l_orderkey""")
def agg16(spark, d):
    s = _sequences(spark, d)
    return s.select("l_orderkey", A.masked_sum(F.col("r"), F.col("m")).alias("masked_sum"), F.round(A.masked_mean(F.col("r"), F.col("m")), 4).alias("masked_mean"), F.round(A.masked_var(F.col("r"), F.col("m")), 4).alias("masked_var"))


@query("win09_return_less_baseline", """
SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 25.0 AS advantage FROM lineitem""")
def win09(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("line").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return _items(spark, d).select("l_orderkey", "l_linenumber", (F.sum("l_quantity").over(w) - 25.0).alias("advantage"))


@query("win07_discounted_returns", """
WITH b AS (SELECT *, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)  AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS p FROM lineitem),
c AS (SELECT * FROM b)
SELECT x.l_orderkey, x.l_linenumber, x.l_quantity + coalesce((SELECT sum(y.l_quantity) FROM c y WHERE y.l_orderkey = x.l_orderkey AND y.p > x.p AND y.k = x.k), 0) AS ret FROM c x""")
def win07(spark, d):
    s = _sequences(spark, d).select("l_orderkey", F.posexplode(A.discounted_returns(F.col("r"), F.col("m"))).alias("p", "ret"))
    lines = _items(spark, d).withColumn("p", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("line")) - 1)
    return s.join(lines, ["l_orderkey", "p"]).select("l_orderkey", "l_linenumber", "ret")


@query("win11_generalised_advantage")
def win11(spark, d):
    s = _sequences(spark, d)
    return s.select("l_orderkey", F.transform(A.gae(F.col("r"), F.col("v"), F.col("m"), 1.0, 0.95), lambda x: F.round(x, 6)).alias("advantages"))


@query("win13_penalised_reward", """
SELECT l_orderkey, l_linenumber, round(l_quantity - 0.1 * (l_discount - l_tax), 6) AS reward, round(l_discount - l_tax, 6) AS k1, round(abs(l_discount - l_tax), 6) AS kabs,
       round(0.5 * (l_discount - l_tax) * (l_discount - l_tax), 6) AS k2, round(exp(l_tax - l_discount) - (l_tax - l_discount) - 1, 6) AS k3 FROM lineitem""")
def win13(spark, d):
    a, b = F.col("l_discount"), F.col("l_tax")
    one = lambda c: F.round(c, 6)
    reward = F.element_at(A.penalised(F.array("l_quantity"), F.array(a), F.array(b), 0.1), 1)
    return _items(spark, d).select("l_orderkey", "l_linenumber", one(reward).alias("reward"), *(one(A.kl_penalty(a, b, k)).alias(n) for k, n in (("k1", "k1"), ("abs", "kabs"), ("k2", "k2"), ("k3", "k3"))))


LOSS = """
WITH s AS (SELECT l_orderkey, sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS x, count(*) FILTER (WHERE l_returnflag <> 'R') AS n, count(*) AS t FROM lineitem GROUP BY l_orderkey)
SELECT round(sum(x) / sum(n), 6) AS token_mean, round(avg(x), 6) AS seq_mean_token_sum, round(avg(x / n), 6) AS seq_mean_token_mean, round(sum(x) / (SELECT max(t) FROM s), 6) AS seq_sum_norm FROM s WHERE n > 0
"""


@query("agg17_loss_modes", LOSS)
def agg17(spark, d):
    on = F.col("l_returnflag") != "R"
    s = _items(spark, d).groupBy("l_orderkey").agg(F.sum(F.when(on, F.col("l_quantity"))).alias("x"), F.count(F.when(on, 1)).alias("n"), F.count("*").alias("t"))
    live = F.col("n") > 0
    return s.agg(F.round(F.sum(F.when(live, F.col("x"))) / F.sum("n"), 6).alias("token_mean"), F.round(F.avg(F.when(live, F.col("x"))), 6).alias("seq_mean_token_sum"), F.round(F.avg(F.when(live, F.try_divide("x", "n"))), 6).alias("seq_mean_token_mean"), F.round(F.sum(F.when(live, F.col("x"))) / F.max("t"), 6).alias("seq_sum_norm"))


@query("joi11_step_advantage_broadcast", """
SELECT l_orderkey, l_linenumber, round(avg(l_quantity) FILTER (WHERE l_returnflag <> 'R' AND last) OVER (PARTITION BY l_orderkey), 6) AS advantage
FROM (SELECT *, l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)""")
def joi11(spark, d):
    """The last step's masked mean goes to every step of its trajectory."""
    w = Window.partitionBy("l_orderkey")
    rows = _items(spark, d).withColumn("last", F.col("l_linenumber") == F.max("l_linenumber").over(w))
    return rows.select("l_orderkey", "l_linenumber", F.round(F.avg(F.when((F.col("l_returnflag") != "R") & F.col("last"), F.col("l_quantity"))).over(w), 6).alias("advantage"))


@query("joi12_semi_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def joi12(spark, d):
    keep = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _items(spark, d).join(keep, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("joi13_anti_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R') OR NOT bool_or(l_returnflag = 'R'))")
def joi13(spark, d):
    return V.reject_uniform(_items(spark, d), GROUP, F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


EPISODES = "SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events"


@query("win14_fatal_step", f"""
WITH e AS ({EPISODES}), r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM e)
SELECT user_id, CAST(coalesce(min(pos - 2) FILTER (WHERE run = 3), CASE WHEN user_id % 2 = 0 THEN NULL ELSE count(*) END) AS BIGINT) AS fatal_step, count(*) AS n_steps FROM r GROUP BY user_id""")
def win14(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", F.struct("ts", "event_id").alias("at"), F.when(F.col("user_id") % 2 == 0, "answer").otherwise("timeout").alias("end"))
    return V.fatal_step(e, ["user_id"], "at", F.col("event_type") == "error", "end")


@query("win15_fatal_mask", f"""
WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS m FROM events),
s AS (SELECT *, CASE WHEN m = 1 AND coalesce(lag(m) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) = 0 THEN 1 ELSE 0 END AS st FROM e),
b AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM s)
SELECT event_id, CASE WHEN k >= user_id % 3 THEN 0 ELSE m END AS masked FROM b""")
def win15(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), F.col("event_type").isin("click", "view").cast("int").alias("m"), (F.col("user_id") % 3).alias("fatal"))
    return V.mask_blocks(e, ["user_id"], "at", "m", "fatal").select("event_id", "masked")


@query("win17_hard_mask", f"""
SELECT user_id, NOT (user_id % 2 = 0 AND avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) <= 0.5) AS masked FROM events GROUP BY user_id""")
def win17(spark, d):
    share = F.avg((F.col("event_type") == "error").cast("double"))
    return table(spark, d, "events").groupBy("user_id").agg((~((F.col("user_id") % 2 == 0) & (share <= 0.5))).alias("masked"))


@query("win18_composite_reward", f"""
WITH e AS ({EPISODES}), r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS run FROM e),
f AS (SELECT *, coalesce(min(CASE WHEN run = 3 THEN pos - 2 END) OVER (PARTITION BY user_id), count(*) OVER (PARTITION BY user_id)) AS fatal FROM r)
SELECT user_id, round(CASE WHEN max(fatal) = 0 THEN 0 ELSE avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos < fatal)
       * (0.2 * avg(CASE WHEN event_type IN ('click', 'view') THEN 1.0 ELSE 0.0 END) FILTER (WHERE pos < fatal) + 0.8 * max(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)) END, 6) AS reward FROM f GROUP BY user_id""")
def win18(spark, d):
    """Format share times (0.2 query share + 0.8 answer), shares over the steps before the fatal one; 0 if that is the first."""
    w = Window.partitionBy("user_id")
    o = w.orderBy("ts", "event_id")
    e = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id").withColumn("pos", F.row_number().over(o) - 1)
    e = e.withColumn("run", F.sum((F.col("event_type") == "error").cast("int")).over(o.rowsBetween(-2, 0)))
    e = e.withColumn("fatal", F.coalesce(F.min(F.when(F.col("run") == 3, F.col("pos") - 2)).over(w), F.count("*").over(w)))
    before = lambda c: F.avg(F.when(F.col("pos") < F.col("fatal"), c.cast("double")))
    reward = before(F.col("event_type") != "error") * (0.2 * before(F.col("event_type").isin("click", "view")) + 0.8 * F.max((F.col("event_type") == "purchase").cast("double")))
    return e.groupBy("user_id").agg(F.round(F.when(F.max("fatal") == 0, 0.0).otherwise(reward), 6).alias("reward"))


@query("win20_step_returns", """
WITH r AS (SELECT *, l_quantity + 0.5 * coalesce(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 0) AS shaped, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, l_linenumber, round(shaped, 6) AS shaped, round(sum(shaped * pow(0.97, i)) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / pow(0.97, i), 9) AS mc_return FROM r""")
def win20(spark, d):
    r = V.step_returns(_items(spark, d), ["l_orderkey"], "line", "l_quantity", 0.5, 0.97)
    return r.select("l_orderkey", "l_linenumber", F.round("shaped", 6).alias("shaped"), F.round("mc_return", 9).alias("mc_return"))


@query("win31_importance_weights", """
SELECT l_orderkey, round(exp(s), 6) AS seq_weight, round(exp(a), 6) AS geo_weight, round(least(exp(s), 2.0), 6) AS truncated, exp(a) BETWEEN 1 / 1.01 AND 1.01 AS kept
FROM (SELECT l_orderkey, sum(l_discount - l_tax) AS s, avg(l_discount - l_tax) AS a FROM lineitem GROUP BY l_orderkey)""")
def win31(spark, d):
    s = _items(spark, d).groupBy("l_orderkey").agg(F.sum(F.col("l_discount") - F.col("l_tax")).alias("s"), F.avg(F.col("l_discount") - F.col("l_tax")).alias("a"))
    return s.select("l_orderkey", F.round(F.exp("s"), 6).alias("seq_weight"), F.round(F.exp("a"), 6).alias("geo_weight"), F.round(F.least(F.exp("s"), F.lit(2.0)), 6).alias("truncated"), F.exp("a").between(1 / 1.01, 1.01).alias("kept"))


@query("win32_clipped_policy_loss", """
SELECT round(avg(greatest(-a * r, -a * least(greatest(r, 0.99), 1.01))), 6) AS loss, round(avg(CASE WHEN -a * least(greatest(r, 0.99), 1.01) > -a * r THEN 1.0 ELSE 0.0 END), 6) AS clip_share, round(avg(-lr), 6) AS kl
FROM (SELECT l_discount - l_tax AS lr, exp(l_discount - l_tax) AS r, l_quantity - 25 AS a FROM lineitem)""")
def win32(spark, d):
    lr = F.col("l_discount") - F.col("l_tax")
    r, a = F.exp(lr), F.col("l_quantity") - 25
    clipped = -a * F.least(F.greatest(r, F.lit(0.99)), F.lit(1.01))
    return _items(spark, d).agg(F.round(F.avg(F.greatest(-a * r, clipped)), 6).alias("loss"), F.round(F.avg((clipped > -a * r).cast("double")), 6).alias("clip_share"), F.round(F.avg(-lr), 6).alias("kl"))


@query("win33_reweight", "SELECT l_orderkey, l_linenumber, round(pow(abs(l_quantity), 2.0), 6) AS weight, CASE WHEN l_quantity = (SELECT max(l_quantity) FROM lineitem) OR l_quantity = (SELECT min(l_quantity) FROM lineitem) THEN 1.0 ELSE 0.0 END AS max_min FROM lineitem")
def win33(spark, d):
    rows = _items(spark, d)
    ends = rows.agg(F.min(SCORE).alias("lo"), F.max(SCORE).alias("hi"))  # one row
    return rows.crossJoin(F.broadcast(ends)).select("l_orderkey", "l_linenumber", F.round(F.pow(F.abs(F.col(SCORE)), F.lit(2.0)), 6).alias("weight"), F.when((F.col(SCORE) == F.col("hi")) | (F.col(SCORE) == F.col("lo")), 1.0).otherwise(0.0).alias("max_min"))
