"""Queries of conversation operators over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions.arrays import length_budget
from gleanery.operators import conversations as V
from gleanery.plans.registry import query, table

M = "SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id"
JOINED = "array_to_string(list_transform({}, lambda x: x.role || ':' || x.content), '|')"


def _text(c):
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")


def _convs(spark, d):
    return V.gather(table(spark, d, "conversations"))


@query("cnv01_instruction_rows", """
SELECT conv_id, turn, 'user:' || h || '|assistant:ok|user:' || text || CASE WHEN turn % 2 = 0 THEN '' ELSE chr(10) || role END AS prompt, 'assistant:' || text AS response
FROM (SELECT *, text AS h FROM conversations)""")
def cnv01(spark, d):
    past = F.array(F.array(F.col("text"), F.lit("ok")))
    row = V.CONVERTERS["instruction"](F.col("text"), F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("role")), F.col("text"), history=past)
    return table(spark, d, "conversations").select("conv_id", "turn", row.alias("a")).select("conv_id", "turn", _text(F.col("a._prompt")).alias("prompt"), _text(F.col("a._response")).alias("response"))


CNV02 = f"""
WITH c AS ({M}), b AS (SELECT conv_id, coalesce(m[1].role = 'system', false) AS sys, m, CASE WHEN coalesce(m[1].role = 'system', false) THEN m[2:] ELSE m END AS body FROM c),
f AS (SELECT *, len(body) AS n, len(body) % 2 = 0 AND len(list_filter(range(1, len(body) + 1), lambda i: CASE WHEN i % 2 = 1 THEN body[i].role <> 'user' ELSE body[i].role <> 'assistant' END)) = 0 AS ok FROM b)
SELECT conv_id, CASE WHEN ok AND n > 0 THEN {JOINED.format('body[:n - 1]')} ELSE '' END AS prompt, CASE WHEN ok AND n > 0 THEN {JOINED.format('body[n:]')} ELSE '' END AS response, CASE WHEN sys THEN m[1].content ELSE '' END AS system FROM f
"""


@query("cnv02_turn_rows", CNV02)
def cnv02(spark, d):
    row = V.CONVERTERS["turns"](F.col("messages"))
    return _convs(spark, d).select("conv_id", row.alias("a")).select("conv_id", _text(F.col("a._prompt")).alias("prompt"), _text(F.col("a._response")).alias("response"), F.col("a._system").alias("system"))


@query("cnv03_merged_observations", f"""
WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' OR turn % 4 = 2 THEN 'observation' ELSE role END AS role, text FROM conversations),
g AS (SELECT *, turn - row_number() OVER (PARTITION BY conv_id, role = 'observation' ORDER BY turn) AS island, max(CASE WHEN role <> 'observation' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM r),
k AS (SELECT conv_id, role, min(turn) AS t, string_agg(text, chr(10) || '</tool_response>' || chr(10) || '<tool_response>' || chr(10) ORDER BY turn) AS x FROM g WHERE role = 'observation' AND turn < last GROUP BY conv_id, role, island
      UNION ALL SELECT conv_id, role, turn, text FROM g WHERE role <> 'observation')
SELECT conv_id, string_agg(role || ':' || x, '|' ORDER BY t) AS merged FROM k GROUP BY conv_id""")
def cnv03(spark, d):
    """Assistant turns and every fourth turn play tool results."""
    rows = table(spark, d, "conversations").withColumn("role", F.when((F.col("role") == "assistant") | (F.col("turn") % 4 == 2), "observation").otherwise(F.col("role")))
    return V.gather(rows).select("conv_id", V.merge_observations(F.col("messages")).alias("m")).where("size(m) > 0").select("conv_id", _text(F.col("m")).alias("merged"))


@query("cnv06_weighted_messages", "SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'assistant' THEN 1.0::DOUBLE ELSE 0 END) AS weight, string_agg('text=' || text, '|' ORDER BY turn) AS parts FROM conversations GROUP BY conv_id")
def cnv06(spark, d):
    w = _convs(spark, d).select("conv_id", V.weighted(F.col("messages")).alias("w"))
    parts = F.array_join(F.transform("w", lambda m: F.concat(m["content"][0]["type"], F.lit("="), m["content"][0]["value"])), "|")
    return w.select("conv_id", F.size("w").cast("long").alias("n"), F.aggregate("w", F.lit(0.0), lambda a, m: a + m["loss_weight"]).alias("weight"), parts.alias("parts"))


@query("cnv08_length_budget", """
WITH l AS (SELECT conv_id, turn, length(text) AS s, coalesce(length(lag(text) OVER (PARTITION BY conv_id ORDER BY turn)), 0) + 1 AS t, 1000 AS c FROM conversations),
m AS (SELECT *, least(t, CASE WHEN t * 2 < c THEN c WHEN s * 2 < c THEN c - s ELSE CAST(floor(c * (t / (s + t))) AS BIGINT) END) AS k FROM l)
SELECT conv_id, turn, CAST(least(s, greatest(c - k, 0)) AS INT) AS source_len, CAST(k AS INT) AS target_len FROM m""")
def cnv08(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("s"), (F.coalesce(F.length(F.lag("text").over(w)), F.lit(0)) + 1).alias("t"))
    return rows.select("conv_id", "turn", length_budget(F.col("s"), F.col("t"), F.lit(1000)).alias("b")).select("conv_id", "turn", "b.*")


@query("cnv10_cnv15_rendered", "SELECT conv_id, string_agg('<|im_start|>' || CASE WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'tool' END || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id")
def cnv10(spark, d):
    return _convs(spark, d).select("conv_id", V.CHATML.render(F.col("messages")).alias("rendered"))


@query("cnv14_tool_calls", """SELECT event_id, 'f_' || event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, 'g', NULL FROM events WHERE event_type = 'click'""")
def cnv14(spark, d):
    call = lambda name, args: F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}\n</tool_call>"))
    text = F.concat(F.lit("thinking "), call(F.concat(F.lit("f_"), "event_type"), F.col("props")), F.when(F.col("event_type") == "click", call(F.lit("g"), F.lit("{}"))).otherwise("<tool_call>bad json</tool_call>"))
    calls = table(spark, d, "events").select("event_id", F.explode(V.tool_calls(text)).alias("c"))
    return calls.select("event_id", "c.name", F.get_json_object("c.arguments", "$.k").cast("long").alias("k"))


@query("cnv17_role_parts", "SELECT conv_id, string_agg(CASE role WHEN 'assistant' THEN 'model' ELSE role END || '/text/' || text, '|' ORDER BY turn) AS parts FROM conversations GROUP BY conv_id")
def cnv17(spark, d):
    p = _convs(spark, d).select("conv_id", V.role_parts(F.col("messages"), {"assistant": "model"}).alias("p"))
    return p.select("conv_id", F.array_join(F.transform("p", lambda m: F.concat_ws("/", m["role"], m["content"][0]["type"], m["content"][0]["text"])), "|").alias("parts"))


@query("cnv18_win30_steps", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS step, rn - 1 AS n_context, text AS response FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE role = 'assistant'")
def cnv18(spark, d):
    return V.steps(_convs(spark, d)).select("conv_id", F.col("step").cast("long").alias("step"), F.size("context").cast("long").alias("n_context"), "response")


@query("win21_cumulative", "SELECT conv_id, true AS is_cumulative FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def win21(spark, d):
    return V.cumulative(V.steps(_convs(spark, d)))


@query("win27_mismatched_responses", "SELECT conv_id, turn, coalesce(lag(text) OVER w, last_value(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS kl_response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def win27(spark, d):
    return V.mismatched(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "kl_response")


@query("joi14_next_observation", "SELECT conv_id, turn, CASE WHEN lead(role) OVER w = 'user' AND contains(lead(t) OVER w, '<tool_response>') THEN lead(t) OVER w ELSE '' END AS observation FROM (SELECT *, CASE WHEN turn % 4 = 0 THEN '<tool_response>' || text ELSE text END AS t FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def joi14(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<tool_response>"), "text")).otherwise(F.col("text")))
    return V.next_observation(rows).select("conv_id", "turn", "observation")


@query("prj30_prj31_valid_messages", f"""
WITH x AS ({CNV02}), c AS (SELECT conv_id, sum(len(string_split(text, 'en')) - 1) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, len(string_split(prompt, '|user:')) >= 1 AND response <> '' AS valid, CAST(n AS INT) AS n_places FROM x JOIN c USING (conv_id)""")
def prj30(spark, d):
    row = V.CONVERTERS["turns"](F.col("messages"))
    a = _convs(spark, d).select("conv_id", "messages", row.alias("a"))
    return a.select("conv_id", V.trainable(F.col("a._prompt"), F.col("a._response")).alias("valid"), V.placeholders(F.col("messages"), "en").alias("n_places"))


@query("cnv20_few_shot", "SELECT source, string_agg('Q: ' || text || chr(10) || 'A: ' || lang, chr(10) ORDER BY doc_id) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY source")
def cnv20(spark, d):
    """The first five documents of each source as its support set (the limit is the feature)."""
    w = Window.partitionBy("source").orderBy("doc_id")
    shots = table(spark, d, "documents").select("source", "doc_id", F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "lang").alias("x")).withColumn("r", F.row_number().over(w)).where("r <= 5")
    rows = F.array_sort(F.collect_list(F.struct("doc_id", "x")))
    return shots.groupBy("source").agg(F.array_join(F.transform(rows, lambda s: s["x"]), "\n").alias("prompt"))


@query("ltl01_best_row", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, length(text) DESC) AS r FROM conversations) WHERE r = 1")
def ltl01(spark, d):
    best = table(spark, d, "conversations").groupBy("conv_id").agg(F.max(F.struct("turn", F.length("text").alias("n"), "text")).alias("b"))
    return best.select("conv_id", "b.turn", "b.text")


@query("ltl02_set12_distinct_prompts", "SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY role, text ORDER BY conv_id, turn) AS r FROM conversations) WHERE r = 1")
def ltl02(spark, d):
    """The first row of each (role, text), found by a digest so that long texts aren't shuffled twice."""
    firsts = table(spark, d, "conversations").groupBy(F.sha2(F.concat_ws("\x00", "role", "text"), 256).alias("k")).agg(F.min(F.struct("conv_id", "turn", "text")).alias("f"))
    return firsts.select("f.*")


@query("str07_chunk_accumulation", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS content FROM conversations GROUP BY conv_id, role")
def str07(spark, d):
    """Recorded deltas, keyed by message, joined in order."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "").alias("content"))
