"""Queries of batches of rows and of training recipes over orders, line items, parts, events, conversations and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import batches as B
from gleanery.operators import recipes as R
from gleanery.operators.datasets import numbered_key, position_in_group, with_position
from gleanery.plans.registry import query, table


def _hash(seed: int, *cols: str, digits: int = 13) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', '{seed}', {', '.join(cols)})), 1, {digits}) AS BIGINT)"


@query("prj02_find", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100")
def prj02(spark, d):
    return B.find(table(spark, d, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100)).select("o_orderkey", "o_orderstatus")


@query("prj04_list", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def prj04(spark, d):
    return B.find(table(spark, d, "customer"))


@query("prj06_prj07_prj08_columns", "SELECT o_orderkey AS key, o_custkey AS customer, 2 AS n_left FROM orders")
def prj06(spark, d):
    """Columns selected and renamed, and how many a second batch keeps."""
    some = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    picked, rest = B.pop_columns(some, ["o_orderkey", "o_custkey"])
    return B.rename_columns(picked, ["o_orderkey", "o_custkey"], ["key", "customer"]).withColumn("n_left", F.lit(len(rest.columns)))


@query("prj11_reorder", "WITH n AS (SELECT count(*) AS n FROM part), p AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) SELECT p_partkey, n - 1 - pos AS pos FROM p, n")
def prj11(spark, d):
    """Parts in reverse, by a table that says which row comes where."""
    rows = with_position(table(spark, d, "part").select("p_partkey"), ["p_partkey"])
    n = rows.count()
    return B.reorder(rows, "pos", spark.range(n).select(F.col("id").alias("pos"), (n - 1 - F.col("id")).alias("src"))).select("p_partkey", "pos")


@query("prj13_rows_at", "SELECT p_partkey, pos FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) WHERE pos % 7 = 0")
def prj13(spark, d):
    """Every seventh row by a list of places that goes beyond the table."""
    rows = with_position(table(spark, d, "part").select("p_partkey"), ["p_partkey"])
    return B.rows_at(rows, "pos", spark.range(rows.count() * 2).where("id % 7 = 0").select(F.col("id").alias("pos")))


@query("prj15_category_slice", "SELECT event_id, pos FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_type = 'click') WHERE pos >= 10 AND pos < 310")
def prj15(spark, d):
    return B.slice_of(table(spark, d, "events").select("event_id", "event_type"), F.col("event_type") == "click", ["event_id"], 10, limit=300).select("event_id", "pos")


@query("prj16_prj17_prompts", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN role ELSE 'none' END AS prompt, CASE WHEN turn % 3 = 1 THEN '' ELSE text END AS present FROM conversations")
def prj16(spark, d):
    t = F.col("turn") % 3
    first = F.when(t == 0, F.array(F.struct(F.col("text").alias("content"))))
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", B.prompt_of(first, F.when(t == 1, F.col("role")).otherwise(""), F.lit("none")).alias("prompt"), B.first_present(F.when(t == 1, ""), F.col("text")).alias("present"))


@query("prj18_benchmark_rows", "SELECT regexp_extract(p_name || '.x.png', '([^/]*)\\.[^./]*$', 1) AS case_id, [p_brand] AS answers, p_type AS question FROM part WHERE trim(p_type) <> ''")
def prj18(spark, d):
    """Parts as benchmark rows: the case is the file's stem, a scalar answer a list of one."""
    path = F.concat("p_name", F.lit(".x.png"))
    return table(spark, d, "part").where(F.trim("p_type") != "").select(F.regexp_extract(path, r"([^/]*)\.[^./]*$", 1).alias("case_id"), F.array("p_brand").alias("answers"), F.col("p_type").alias("question"))


@query("prj22_solution", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) // 1000 * 1000 + 7 AS want, CAST(CAST(o_totalprice AS BIGINT) // 1000 * 1000 + 7 AS VARCHAR) AS solution FROM orders")
def prj22(spark, d):
    n = F.round("o_totalprice").cast("long")
    n = F.floor(F.col("n") / 1000) * 1000 + 7
    rows = table(spark, d, "orders").select("o_orderkey", F.expr("cast(rint(o_totalprice) as bigint)").alias("n")).select("o_orderkey", n.alias("want"))
    text = F.concat(F.lit("so we get\n#### "), F.format_number("want", 0), F.lit(" dollars"))
    return rows.select("o_orderkey", "want", R.solution_after_marks(text).alias("solution"))


@query("prj26_text_nodes", "SELECT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || '...' ELSE text END AS shown FROM documents WHERE lang = 'en'")
def prj26(spark, d):
    """English documents as text nodes, each with its abbreviation (which is the feature)."""
    shown = F.when(F.length("text") > 300, F.concat(F.left("text", F.lit(300)), F.lit("..."))).otherwise(F.col("text"))
    return B.find(table(spark, d, "documents"), F.col("lang") == "en").select("doc_id", shown.alias("shown"))


@query("prj29_proof_filter", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def prj29(spark, d):
    """Events whose recorded verdict says that the proof is one."""
    verdict = F.when(F.col("event_type") == "click", "yes [[1]]").when(F.col("event_type") == "purchase", "[[2]] so so").when(F.col("event_type") == "view", "[[3]]")
    return table(spark, d, "events").where(R.kept_proofs(verdict, ("[[1]]", "[[2]]"))).select("event_id")


@query("joi01_answer_lookup", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus || ', ' || o_orderpriority ELSE coalesce(c_name, '') END AS correct_answer FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 20")
def joi01(spark, d):
    """Orders as runs: some bring their answers, others have them on record or nowhere."""
    own = F.when(F.col("o_orderstatus") == "F", F.array("o_orderstatus", "o_orderpriority")).otherwise(F.array().cast("array<string>"))
    runs = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + 20).alias("case_id"), own.alias("answers"))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("answer"))
    return R.looked_up_answers(runs, known, "case_id", "answers").select("o_orderkey", "correct_answer")


_LINKS = "SELECT l_orderkey AS page, l_linenumber AS rank, l_partkey AS url FROM lineitem"


@query("joi03_grounded_entities", "SELECT o_orderkey AS image, l.name AS label, n.node, CASE WHEN n.node IS NULL THEN 'unresolved' ELSE 'edge' END AS status FROM orders, (SELECT unnest(['1-URGENT', '5-LOW']) AS name) l LEFT JOIN (SELECT o_orderpriority AS label, min(o_orderkey) AS node FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1) n ON n.label = l.name WHERE o_orderstatus = 'F'")
def joi03(spark, d):
    """Orders as images said to show two priorities, of which one has a node."""
    orders = table(spark, d, "orders")
    nodes = orders.where("o_orderpriority = '5-LOW'").groupBy(F.col("o_orderpriority").alias("label")).agg(F.min("o_orderkey").alias("node"))
    images = orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("image"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")).alias("names"))
    return R.grounded_edges(images, nodes, "image", "names", "label")


@query("joi04_neighbour_split", f"""
SELECT page, rank, url, CASE WHEN url % 3 = 0 THEN 'edge' WHEN url % 3 = 1 THEN 'attach' ELSE 'enqueue' END AS action
FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY rank, url) AS r FROM (SELECT page, min(rank) AS rank, url FROM ({_LINKS}) GROUP BY page, url)) WHERE r <= 3""")
def joi04(spark, d):
    """The first three parts of each order (the limit is the feature), by whether their page is known, waits or is new."""
    links = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("url")).agg(F.min("l_linenumber").alias("rank"))
    parts = links.select("url").distinct()
    out = R.split_neighbours(links, parts.where("url % 3 = 0"), parts.where("url % 3 = 1"), "page", "url", "rank", 3)
    return out.select("page", "rank", "url", "action")


@query("joi06_edges_to_known", "SELECT l_orderkey AS src, p_partkey AS dst, 'mentions ' || min(p_name) AS relation, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def joi06(spark, d):
    lines = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("l_orderkey").alias("src"), F.col("p_partkey").alias("dst")).agg(F.concat(F.lit("mentions "), F.min("p_name")).alias("relation"), F.count("*").alias("n"))


@query("joi07_pending_links", "SELECT DISTINCT l_orderkey, l_returnflag, l_partkey FROM lineitem")
def joi07(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_partkey").dropDuplicates(["l_orderkey", "l_returnflag", "l_partkey"])


@query("joi19_evidence_images", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 'local/' || user_id WHEN user_id % 4 = 1 THEN 'https://img/' || user_id END AS image FROM events")
def joi19(spark, d):
    """Events name an image by its key; the map has a path, an address or nothing."""
    k = F.col("user_id")
    paths = F.when(k % 4 == 0, F.create_map(k, F.concat(F.lit("local/"), k))).when(k % 4 == 1, F.create_map(k, F.concat(F.lit("https://img/"), k)))
    return table(spark, d, "events").select("event_id", F.try_element_at(paths, k).alias("image"))


@query("agg28_sizes", """
SELECT doc_id, CASE WHEN s >= 1073741824 THEN format('{:.2f} GB', s / 1073741824.0) WHEN s >= 1048576 THEN format('{:.2f} MB', s / 1048576.0) WHEN s >= 1024 THEN format('{:.2f} KB', s / 1024.0) ELSE s || ' B' END AS shown,
       CASE WHEN s < 60 THEN format('{:.2f}s', s::DOUBLE) WHEN s < 3600 THEN (s // 60) || 'm ' || format('{:.2f}s', (s % 60)::DOUBLE) ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm ' || format('{:.2f}s', (s % 60)::DOUBLE) END AS took
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS s FROM documents)""")
def agg28(spark, d):
    n = F.octet_length("text").cast("long")
    return table(spark, d, "documents").select("doc_id", B.human_bytes(n).alias("shown"), B.human_seconds(n.cast("double")).alias("took"))


@query("agg29_merged_metrics", "SELECT event_type AS name, array_agg(value ORDER BY event_id) AS vals FROM events GROUP BY event_type UNION ALL SELECT 'user', array_agg(user_id::DOUBLE ORDER BY event_id) FROM events")
def agg29(spark, d):
    m = B.merged_metrics([F.create_map(F.lit("user"), F.lit(0.0)), F.create_map(F.col("event_type"), F.col("value")), F.create_map(F.lit("user"), F.col("user_id").cast("double"))])
    return B.lists_of_metrics(table(spark, d, "events").select("event_id", m.alias("m")), "m", "event_id").select("name", F.col("values").alias("vals"))


@query("win28_batch_order", "SELECT o_orderkey, row_number() OVER (ORDER BY -o_totalprice, o_orderkey) - 1 AS place FROM orders")
def win28(spark, d):
    """Results of a batch by priority, the highest price first."""
    rows = table(spark, d, "orders").select("o_orderkey", (-F.col("o_totalprice")).alias("priority"))
    return with_position(rows, ["priority", "o_orderkey"], "place").select("o_orderkey", "place")


@query("win29_step_groups", "SELECT g AS \"group\", count(*) AS n, sum(value) AS total FROM (SELECT CASE WHEN event_type = 'view' THEN 'row-' || event_id ELSE CAST(user_id AS VARCHAR) END AS g, value FROM events) GROUP BY g")
def win29(spark, d):
    e = table(spark, d, "events").withColumn("k", F.when(F.col("event_type") != "view", F.col("user_id")))
    return B.group_steps(e, "k", "event_id").groupBy("group").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("srt01_sorted_table", "SELECT c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer")
def srt01(spark, d):
    return with_position(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"]).select("c_name", "pos")


@query("srt04_frontier", "SELECT l_partkey AS url, min(l_orderkey * 100 + l_linenumber) AS seq FROM lineitem WHERE l_partkey % 10 <> 3 GROUP BY l_partkey")
def srt04(spark, d):
    tasks = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("url"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq")).agg(F.count("*").alias("n"))
    return B.frontier(tasks, "url", "seq", tasks.where("url % 10 = 3")).select("url", "seq")


@query("srt07_page_order", "SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, event_id), event_id) - 1 AS place FROM events")
def srt07(spark, d):
    """Results by their index, or where they have none by their page."""
    e = table(spark, d, "events").select("event_id", "event_type", F.coalesce(F.when(F.col("user_id") % 2 == 0, F.col("user_id")), F.col("event_id")).alias("at"))
    return position_in_group(e, ["event_type"], ["at", "event_id"], "place").select("event_id", "place")


@query("srt10_train_val", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_hash(42, 'o_orderkey')}, o_orderkey) <= floor(n * 0.1) THEN 'validation' ELSE 'train' END AS part FROM orders, (SELECT count(*) AS n FROM orders)")
def srt10(spark, d):
    return B.train_val_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.1)


@query("ltl10_fixed_count_split", f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_hash(42, 'o_orderkey')}, o_orderkey) <= 500 THEN 'validation' ELSE 'train' END AS part FROM orders")
def ltl10(spark, d):
    """500 rows to test on (the number is the feature)."""
    return B.train_val_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500)


@query("srt12_resized", f"""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY {_hash(42, 'p_partkey')}, p_partkey) - 1 AS p, count(*) OVER () AS n FROM part),
m AS (SELECT count(*) AS have FROM part), g AS (SELECT unnest(range(1, (SELECT have * 5 // 2 - have + 1 FROM m))) AS draw),
t AS (SELECT draw, CAST('0x' || substr(md5('42:draw:' || draw), 1, 13) AS BIGINT) % have AS p FROM g, m)
SELECT p_partkey, CAST(0 AS BIGINT) AS draw FROM p UNION ALL SELECT p_partkey, draw FROM t JOIN p USING (p)""")
def srt12(spark, d):
    """Two and a half times as many parts: all of them, and then draws with replacement."""
    parts = table(spark, d, "part").select("p_partkey")
    return B.resized(parts, "p_partkey", parts.count() * 5 // 2)


@query("srt22_mini_batches", f"""
SELECT c_custkey, epoch, (p - 1) // 64 AS batch, (p - 1) % 64 AS at
FROM (SELECT c_custkey, epoch, row_number() OVER (PARTITION BY epoch ORDER BY {_hash(42, 'epoch', 'c_custkey', digits=12)}, c_custkey) AS p FROM customer, (SELECT unnest([0, 1]) AS epoch))""")
def srt22(spark, d):
    return B.mini_batches(table(spark, d, "customer").select("c_custkey"), "c_custkey", 64, 2).select("c_custkey", "epoch", "batch", "at")


@query("srt25_document_index", f"SELECT doc_id, epoch, row_number() OVER (ORDER BY CASE WHEN epoch = 2 THEN 1 ELSE 0 END, {_hash(1, 'epoch', 'doc_id', digits=12)}, doc_id, epoch) - 1 AS pos FROM documents, (SELECT unnest([0, 1, 2]) AS epoch)")
def srt25(spark, d):
    return B.document_index(table(spark, d, "documents").select("doc_id"), "doc_id", 3, separate_last=True)


@query("set04_exhaustive_blend", "SELECT event_id, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, event_type) - 1 AS place FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)")
def set04(spark, d):
    """Events as data sets by type, all rows of each."""
    rows = position_in_group(table(spark, d, "events").select("event_id", "event_type"), ["event_type"], ["event_id"], "r")
    return B.exhaustive_blend(rows, "event_type", "r").select("event_id", "place")


@query("set05_blend_sizes", "SELECT * FROM (VALUES (0, 0, 703), (0, 1, 71), (1, 0, 302), (1, 1, 31)) t(dataset, split, size)")
def set05(spark, d):
    sizes = B.blend_sizes([7.0, 3.0], [1000, 100], 0.004)
    return spark.createDataFrame([(i, j, n) for i, row in enumerate(sizes) for j, n in enumerate(row)], "dataset int, split int, size int")


@query("set09_fold_unfold", "SELECT (p - 1) // (n // 50) AS \"group\", CAST((p - 1) % (n // 50) AS INT) AS at, c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS p, count(*) OVER () AS n FROM customer)")
def set09(spark, d):
    rows = with_position(table(spark, d, "customer").select("c_custkey"), ["c_custkey"])
    return B.unfold(B.fold(rows, "pos", 50, rows.count(), ["c_custkey"]), ["c_custkey"])


@query("set17_padded_batch", """
WITH r AS (SELECT l_orderkey, array_agg(l_partkey ORDER BY l_linenumber, l_partkey) AS ids FROM lineitem GROUP BY 1), b AS (SELECT *, l_orderkey // 16 AS batch, max(len(ids)) OVER (PARTITION BY l_orderkey // 16) AS n FROM r)
SELECT batch, l_orderkey, list_resize(ids, n, 0) AS input_ids, list_resize(list_transform(ids, lambda x: 1), n, 0) AS attention_mask, list_resize(ids, n, -100) AS labels FROM b""")
def set17(spark, d):
    """Orders as token rows in batches of sixteen."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))
    rows = rows.select(F.floor(F.col("l_orderkey") / 16).alias("batch"), "l_orderkey", F.col("r.l_partkey").alias("ids"))
    return B.padded(rows, "batch", "l_orderkey", "ids", 0)


@query("fnc12_model_flops", "SELECT p_partkey, CAST(3 * (s * 1024 * 2 * (6 * 64 * 256 + 4 * 64 * 64 + 2 * (2 * 64 * 64 * 2 // 8)) + s * 2 * 4 * 64 * 1024 * 1024) + 3 * s * 1024 * 64 * 1000 * 2 AS BIGINT) AS flops FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS s FROM part)")
def fnc12(spark, d):
    return table(spark, d, "part").select("p_partkey", B.model_flops(F.col("p_size").cast("long"), F.lit(1024).cast("long"), 64, 256, 8, 2, 2, 1000).alias("flops"))


@query("fnc15_merged_maps", "SELECT event_id, CASE WHEN event_type = 'a' THEN value ELSE value END AS v, len(list_distinct(['a', event_type, 'b'])) AS n FROM events")
def fnc15(spark, d):
    one = lambda k, v: F.create_map(k, v)
    m = B.merged_metrics([one(F.lit("a"), F.lit(1.0)), one(F.lit("b"), F.lit(2.0)), one(F.col("event_type"), F.col("value"))])
    return table(spark, d, "events").select("event_id", F.element_at(m, F.col("event_type")).alias("v"), F.size(F.map_keys(m)).cast("long").alias("n"))


@query("txt34_research_answer", r"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN trim(text) WHEN 1 THEN '{' || text || '}' ELSE trim(text) END AS answer
FROM conversations""")
def txt34(spark, d):
    """Turns as responses: with answer tags, with a box that holds brackets, and with thoughts alone."""
    t = F.col("turn") % 3
    made = F.when(t == 0, F.concat(F.lit("<think>x<answer>no</answer></think>so <ANSWER> "), "text", F.lit(" </answer> end"))).when(t == 1, F.concat(F.lit("thus \\boxed{{"), "text", F.lit("}} and {more}"))).otherwise(F.concat(F.lit("<think>\n y</think>"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", R.research_answer(made).alias("answer"))


@query("cnv05_media_paths", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'media/' || p_name ELSE p_name END AS resolved FROM part")
def cnv05(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit("-"), "p_partkey").alias("name"), "p_name")
    there = parts.where("p_partkey % 3 = 0").select(F.concat(F.lit("media/"), "name").alias("path"))
    found = R.resolved_media(parts, "name", "media/", there)
    return found.select("p_partkey", F.regexp_replace("resolved", "-[0-9]+$", "").alias("resolved"))


@query("cnv11_slots", "SELECT c_custkey, 'Dear ' || c_name || ', of ' || c_mktsegment || '. {{other}}' AS text FROM customer")
def cnv11(spark, d):
    return table(spark, d, "customer").select("c_custkey", R.filled_slots(F.lit("Dear {{name}}, of {{segment}}. {{other}}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")}).alias("text"))


@query("cnv16_placeholders", "SELECT p_partkey, 'a ' || repeat('<t>', p_size) || ' b <t><t> c <image>' AS text FROM part")
def cnv16(spark, d):
    return table(spark, d, "part").select("p_partkey", R.expanded_placeholders(F.lit("a <image> b <image> c <image>"), "<image>", "<t>", F.array(F.col("p_size"), F.lit(2))).alias("text"))


@query("cnv13_token_masks", """
SELECT conv_id, turn, role = 'assistant' AS all_trained, role = 'assistant' AND turn = last AS last_trained, len(tokens) AS n
FROM (SELECT conv_id, turn, role, max(turn) OVER (PARTITION BY conv_id) AS last, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS tokens FROM conversations) WHERE len(tokens) > 0""")
def cnv13(spark, d):
    """How many tokens of each turn there are, and whether they are trained on: in all answers, or in the last message alone."""
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content")).alias("m")).groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    each = rows.select("conv_id", "m", R.token_masks(F.col("m")).alias("a"), R.token_masks(F.col("m"), last_only=True).alias("b"))
    sizes = F.transform("m", lambda m: F.size(F.filter(F.split(m["content"], r"\s+"), lambda t: t != "")))
    named = F.flatten(F.zip_with(F.col("m"), sizes, lambda m, n: F.array_repeat(m["turn"], n)))
    x = each.select("conv_id", F.explode(F.arrays_zip(named.alias("turn"), F.col("a.trained").alias("a"), F.col("b.trained").alias("b"))).alias("x"))
    return x.groupBy("conv_id", F.col("x.turn").alias("turn"), F.col("x.a").alias("all_trained"), F.col("x.b").alias("last_trained")).agg(F.count("*").alias("n"))


@query("cnv19_episode_batch", """
WITH s AS (SELECT l_orderkey AS episode, l_linenumber AS step, array_agg(l_partkey ORDER BY l_partkey) AS ids FROM lineitem GROUP BY 1, 2),
n AS (SELECT episode, step, ids, row_number() OVER (PARTITION BY episode ORDER BY step) - 1 AS k, count(*) OVER (PARTITION BY episode) AS n FROM s)
SELECT episode, CAST(k AS INT) AS step, list_resize(ids[:4], 4, 0) AS ids, list_transform(range(1, 5), lambda i: CASE WHEN i = least(len(ids), 4) AND k = n - 1 THEN o_totalprice ELSE 0.0::DOUBLE END) AS rewards, o_orderstatus = 'F' AS trained
FROM n JOIN orders ON o_orderkey = episode""")
def cnv19(spark, d):
    """Orders as episodes: a step for each line number, its parts as tokens."""
    steps = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    steps = steps.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "ids"))).alias("s"))
    ended = F.when(F.col("o_orderstatus") == "F", "done").otherwise("error")
    e = steps.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("episode"), F.col("o_totalprice").alias("reward"), ended.alias("ended"), F.col("s.ids").alias("steps"))
    return R.episode_batch(e, "steps", 4)


@query("cnv21_trace_steps", "SELECT event_id, CAST(2 AS INT) AS n_messages, event_type AS output, CAST(user_id AS VARCHAR) AS model FROM events")
def cnv21(spark, d):
    said = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    trace = F.to_json(F.struct(F.struct(F.array(said("user", F.col("props"))).alias("messages")).alias("input"), F.struct(said("assistant", F.col("event_type")).alias("message")).alias("output"), F.create_map(F.lit("model"), F.col("user_id").cast("string")).alias("metadata")))
    return table(spark, d, "events").select("event_id", R.step_of_trace(trace)["n_messages"].alias("n_messages"), R.step_of_trace(trace)["output"].alias("output"), R.step_of_trace(trace)["model"].alias("model"))


@query("cnv07_encoded_turns")
def cnv07(spark, d):
    """Orders as conversations of token ids: a turn for each line, encoded with and without its history."""
    ids = lambda a, n: F.transform(F.sequence(F.lit(1), n), lambda i: (a * 10 + i).cast("long"))
    turn = F.struct("l_linenumber", "l_partkey", ids(F.col("l_partkey"), F.col("l_linenumber")).alias("source"), ids(F.col("l_suppkey"), F.col("l_quantity").cast("int")).alias("target"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    a, b = R.encoded_turns(F.col("t"), 64), R.encoded_turns(F.col("t"), 64, mask_history=True)
    return rows.select("l_orderkey", a["input_ids"].alias("ids"), a["labels"].alias("labels"), b["input_ids"].alias("last_ids"), b["labels"].alias("last_labels"))


@query("cnv09_pairs", "SELECT l_orderkey, side, n FROM (SELECT l_orderkey, max(l_linenumber) AS a, min(l_linenumber) AS b FROM lineitem GROUP BY 1), (SELECT unnest(['chosen', 'rejected']) AS side), LATERAL (SELECT CAST(CASE side WHEN 'chosen' THEN a ELSE b END AS INT) AS n)")
def cnv09(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("a"), F.min("l_linenumber").alias("b"))
    ids = lambda n: F.sequence(F.lit(1), F.col(n))
    return rows.select("l_orderkey", F.explode(R.paired(ids("a"), ids("b"))).alias("p")).select("l_orderkey", "p.side", F.size("p.ids").alias("n"))


@query("evl12_open_answers", "SELECT o_orderkey, ['p' || o_orderkey, '12,345 at 1.5e3'] AS answers, [12345.0::DOUBLE, 1500.0::DOUBLE, 345.0::DOUBLE, 1.0::DOUBLE, 3.0::DOUBLE] AS numbers FROM orders")
def evl12(spark, d):
    """Orders as open responses of two clauses that name an answer each."""
    text = F.concat(F.lit("The key is P"), F.col("o_orderkey").cast("string"), F.lit("\nno sign here\nSo the final answer = 12,345 at 1.5e3."))
    return table(spark, d, "orders").select("o_orderkey", R.open_answers(text).alias("answers"), R.numbers_in(F.element_at(R.open_answers(text), -1)).alias("numbers"))


@query("ltl03_ltl04_collapsed", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text ELSE role END AS ground_truth, 'system|user|assistant' AS roles FROM conversations")
def ltl03(spark, d):
    t = F.col("turn") % 2 == 0
    prompt = F.array(R.message("user", F.col("text")))
    row = R.collapsed(prompt, [F.lit(None).cast("string"), F.when(t, F.col("text")).otherwise(""), F.col("role")], "help")
    done = R.completed(prompt, F.col("role"), "help")
    return table(spark, d, "conversations").select("conv_id", "turn", row["ground_truth"].alias("ground_truth"), F.array_join(F.transform(done, lambda m: m["role"]), "|").alias("roles"))


@query("ltl05_benchmark_rows", "SELECT o_orderkey, o_orderpriority AS question FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1995-08' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-02' UNION ALL SELECT c_custkey, c_name FROM customer")
def ltl05(spark, d):
    """Two subsets of a benchmark, one filtered by its dates as texts."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    a = table(spark, d, "orders").where((day >= "1995-08") & (day < "1996-02")).select("o_orderkey", F.col("o_orderpriority").alias("question"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_name").alias("question"))
    return B.all_of([a, b])


@query("ltl07_ltl08_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND length(props) > 0")
def ltl07(spark, d):
    return B.find(table(spark, d, "events"), (F.col("event_type") == "click") & (F.length("props") > 0)).select("event_id")


@query("ltl09_named_subsets", "SELECT 'F' AS subset, o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'O', o_orderkey FROM orders WHERE o_orderstatus = 'O'")
def ltl09(spark, d):
    orders = table(spark, d, "orders")
    return B.all_of([orders.where(F.col("o_orderstatus") == s).select(F.lit(s).alias("subset"), "o_orderkey") for s in ("F", "O")])


@query("ltl11_tool_traces", "SELECT conv_id, turn, ['assistant:so <code>' || role || '</code>', 'tool:' || turn, 'assistant:<answer>' || role || '</answer>'] AS messages FROM conversations")
def ltl11(spark, d):
    text = F.concat(F.lit("so <code>"), "role", F.lit("</code>\n<interpreter>"), F.col("turn").cast("string"), F.lit("</interpreter>\n<answer>"), "role", F.lit("</answer>"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.transform(R.tool_trace(text), lambda m: F.concat(m["role"], F.lit(":"), m["content"])).alias("messages"))


@query("ltl13_counted_letters", "SELECT p_partkey, 'a = a.' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END || CASE WHEN p_partkey % 2 = 0 THEN ' != ' ELSE ' = ' END || 'a.' || chr(10) || '\\boxed{' || CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END || '} a in a-' || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END || '.' AS answer FROM part")
def ltl13(spark, d):
    word = F.concat(F.lit("a-"), F.when(F.col("p_partkey") % 2 == 0, "b").otherwise("a"))
    return table(spark, d, "part").select("p_partkey", R.counted_letters(word, F.lit("a")).alias("answer"))


@query("ltl14_countdown", "SELECT l_orderkey, 'Reach ' || sum(l_linenumber) || ' with the numbers ' || string_agg(l_linenumber, ', ' ORDER BY l_linenumber) || ', each used once at most, and put the calculation between <answer> and </answer>.' AS question FROM lineitem GROUP BY 1")
def ltl14(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"), F.sum("l_linenumber").alias("t"))
    return rows.select("l_orderkey", R.countdown_question(F.col("n"), F.col("t")).alias("question"))


@query("src18_benchmark_images", "SELECT p_partkey, p_name AS picture, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'unknown' END AS category FROM part")
def src18(spark, d):
    """Parts as images in base 64, whose category is the second part of their id."""
    rows = table(spark, d, "part").select("p_partkey", F.base64(F.encode("p_name", "UTF-8")).alias("image"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("q_"), "p_brand", F.lit("_1"))).otherwise("q").alias("id"))
    return rows.select("p_partkey", F.decode(F.unbase64("image"), "UTF-8").alias("picture"), F.coalesce(F.try_element_at(F.split("id", "_"), F.lit(2)), F.lit("unknown")).alias("category"))


@query("src20_answer_map", "SELECT o_custkey AS id, max_by(o_orderpriority, o_orderkey) AS answer FROM orders GROUP BY 1")
def src20(spark, d):
    """Answers by id, of which the last of each counts."""
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("answer"))


@query("str02_shuffle_take_skip", f"SELECT event_id, CASE WHEN p <= 100 THEN 'take' ELSE 'skip' END AS part FROM (SELECT event_id, row_number() OVER (ORDER BY {_hash(7, 'event_id')}, event_id) AS p FROM events)")
def str02(spark, d):
    """The first 100 of a shuffled stream and the rest (the number is the feature)."""
    rows = with_position(table(spark, d, "events").select("event_id").withColumn("h", numbered_key(7, "event_id")), ["h", "event_id"])
    return rows.select("event_id", B.split_of(F.col("pos"), 100, 0).alias("part")).replace({"validation": "take", "train": "skip"}, subset=["part"])
