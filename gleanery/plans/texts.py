"""Queries of text, HTML, answer and id functions over pages, documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.plans.registry import query, table


def _sub(x: str, *patterns: str) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


def _q(p: str) -> str:
    return p.replace("'", "''")


_ANCHORS = _sub(_sub("html", T.SCRIPT, T.STYLE, T.META, T.COMMENT, T.LINK), T.A_OPEN, T.A_CLOSE)
_ALT = _sub(f"""regexp_replace(regexp_replace({_ANCHORS}, '{_q(T.BASE64_IMG)}', '<img src="#"/>', 'g'), '{_q(T.IMG_WITH_ALT)}', ' \\1 ', 'g')""", T.IMG)
CLEAN_SQL = f"""regexp_replace({_sub(_ALT, T.URL_ATTR, T.BARE_URL)}, '{_q(T.SVG)}', '\\1this is a placeholder\\3', 'g')"""


@query("txt01_clean_html", f"SELECT page_id, {CLEAN_SQL} AS clean FROM pages")
def txt01(spark, d):
    return table(spark, d, "pages").select("page_id", T.clean_html(F.col("html")).alias("clean"))


@query("txt04_strip_anchors_and_urls", f"SELECT page_id, {_sub('html', T.A_OPEN, T.A_CLOSE)} AS no_anchors, {_sub('html', T.URL_ATTR, T.BARE_URL)} AS no_urls FROM pages")
def txt04(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_anchors(F.col("html")).alias("no_anchors"), T.strip_urls(F.col("html")).alias("no_urls"))


def _rfind(h: str, b: str) -> str:
    n = b.replace("\n", "' || chr(10) || '")
    back = f"strpos(reverse({h}), reverse('{n}'))"
    return f"CASE WHEN {back} > 0 THEN length({h}) - {back} - {len(b)} + 1 ELSE -1 END"


_CUT = ", ".join(f"CASE WHEN {_rfind('h', b)} >= 650 THEN {_rfind('h', b)} + {len(b)} END" for b in T.BREAKS)


@query("txt06_truncate_safely", f"SELECT page_id, CASE WHEN length(html) <= 1000 THEN html ELSE rtrim(substr(html, 1, coalesce({_CUT}, 1000)), ' ') || chr(10) || '[truncated]' END AS cut FROM (SELECT *, substr(html, 1, 1000) AS h FROM pages)")
def txt06(spark, d):
    return table(spark, d, "pages").select("page_id", T.truncate_safely(F.col("html"), 1000).alias("cut"))


@query("txt08_txt18_urls", r"""
SELECT page_id, CASE WHEN regexp_matches(bare, '^https?://') THEN bare ELSE 'https://' || bare END AS url,
       nullif(lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([^./]+)$', 1)), '') AS extension,
       nullif(replace(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1), '_', ' '), '') AS title
FROM (SELECT page_id, url, regexp_replace(url, '^http://', '') AS bare FROM pages)""")
def txt08(spark, d):
    return table(spark, d, "pages").select("page_id", T.normalize_url(F.regexp_replace("url", "^http://", "")).alias("url"), T.url_extension(F.col("url")).alias("extension"), T.title_from_url(F.col("url")).alias("title"))


@query("txt11_first_paragraph", r"SELECT doc_id, substr(trim(coalesce(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda b: trim(b) <> '')[1], '')), 1, 1000) AS lead FROM documents")
def txt11(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(T.first_paragraph(F.col("text")), F.lit("")).alias("lead"))


@query("txt13_entity_label", r"SELECT item_id, trim(lower(regexp_replace(text, '[^0-9a-zA-Z\x{4e00}-\x{9fff}]+', ' ', 'g'))) AS label FROM benchmark")
def txt13(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.entity_label(F.col("text")).alias("label"))


@query("txt19_strip_html", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM pages")
def txt19(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("plain"))


@query("txt17_txt16_predicates_and_clamps", r"""
SELECT event_id, coalesce(nullif(regexp_replace(trim(regexp_replace(event_type || ' ,', '\s+', ' ', 'g')), '^[\s.,:;]+|[\s.,:;]+$', '', 'g'), ''), 'related to') AS predicate,
       greatest(least(try_cast(regexp_extract(props, '(\d+)', 1) AS DOUBLE), 50.0), 5.0) AS clamped FROM events""")
def txt17(spark, d):
    return table(spark, d, "events").select("event_id", T.predicate(F.concat("event_type", F.lit(" ,"))).alias("predicate"), T.clamp(F.regexp_extract("props", r"(\d+)", 1), 5.0, 50.0).alias("clamped"))


@query("txt21_repetition", "SELECT conv_id, turn, CASE WHEN length(text) < 30 THEN false ELSE len(list_distinct(list_transform(range(1, length(text) - 28), lambda i: substr(text, i, 30)))) / (length(text) - 29) < 0.5 END AS repetitive FROM conversations")
def txt21(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.repetition(F.col("text")).alias("repetitive"))


@query("txt22_english_words", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+(?:[''-][A-Za-z]+)*')) AS INT) AS n_words FROM documents")
def txt22(spark, d):
    return table(spark, d, "documents").select("doc_id", T.english_words(F.col("text")).alias("n_words"))


@query("txt23_middle_truncation", "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 100) || ' ... ' || right(text, 100) ELSE text END AS cut FROM documents")
def txt23(spark, d):
    return table(spark, d, "documents").select("doc_id", T.middle_truncate(F.col("text"), 200).alias("cut"))


#: A trajectory's turn made of a conversation's row: a thought, and then what its place in the conversation says.
_TURN_SQL = "'<think>' || text || '</think>' || CASE turn % 4 WHEN 0 THEN '<tool_call>' || text || '</tool_call>' WHEN 1 THEN '<answer> ' || text || '</answer>' WHEN 2 THEN '<response>' || text || '</response> ' ELSE text END"


def _turns(spark, d):
    k = F.col("turn") % 4
    inside = lambda a, b: F.concat(F.lit(a), F.col("text"), F.lit(b))
    tail = F.when(k == 0, inside("<tool_call>", "</tool_call>")).when(k == 1, inside("<answer> ", "</answer>")).when(k == 2, inside("<response>", "</response> ")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(inside("<think>", "</think>"), tail).alias("t"))


def _between(tag: str) -> str:
    return f"CASE WHEN regexp_matches(t, '(?s)<{tag}>(.*?)</{tag}>') THEN trim(regexp_extract(t, '(?s)<{tag}>(.*?)</{tag}>', 1)) END"


@query("txt25_win19_actions", f"""
SELECT conv_id, turn, CASE WHEN {_between('tool_call')} IS NOT NULL THEN 'tool_call' WHEN {_between('response')} IS NOT NULL OR {_between('answer')} IS NOT NULL THEN 'final_answer' ELSE 'reasoning' END AS kind,
       coalesce({_between('tool_call')}, {_between('response')}, {_between('answer')}, t) AS content,
       CASE WHEN regexp_matches(t, '(?s)^<think>.*?</think>\\s*(<tool_call>.*?</tool_call>|<response>.*?</response>|<answer>.*?</answer>)\\s*$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS format_reward
FROM (SELECT conv_id, turn, {_TURN_SQL} AS t FROM conversations)""")
def txt25(spark, d):
    a = T.action(F.col("t"))
    return _turns(spark, d).select("conv_id", "turn", a["kind"].alias("kind"), a["content"].alias("content"), T.valid_format(F.col("t")).cast("double").alias("format_reward"))


@query("txt26_final_answer", f"""
SELECT conv_id, turn, coalesce({_between('answer')}, {_between('response')}, nullif(left(trim(regexp_replace(split_part(t, '</think>', 2), '(?s)<tool_call>.*?</tool_call>', '', 'g')), 2000), ''), right(t, 2000)) AS answer
FROM (SELECT conv_id, turn, {_TURN_SQL} AS t FROM conversations)""")
def txt26(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.final_answer(F.col("t")).alias("answer"))


@query("txt27_judge_verdict", "SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END AS acc FROM events")
def txt27(spark, d):
    raw = F.when(F.col("event_type").isin("click", "purchase"), F.concat(F.lit("reasoning: x\nCorrect: YES "), "props")).when(F.col("event_type") == "view", "correct: no, not yes").otherwise("none")
    return table(spark, d, "events").select("event_id", T.verdict(raw).alias("acc"))


_NORM = r"list_filter(regexp_split_to_array(trim(regexp_replace(lower({x}), '[!\x22#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g')), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', ''))"
_PAIRS = "SELECT conv_id, turn, text AS p, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations"


@query("txt28_answer_f1", f"""
WITH n AS (SELECT conv_id, turn, {_NORM.format(x='p')} AS p, {_NORM.format(x='g')} AS g FROM ({_PAIRS}) WHERE g IS NOT NULL),
s AS (SELECT *, list_sum(list_transform(list_distinct(p), lambda t: least(len(list_filter(p, lambda u: u = t)), len(list_filter(g, lambda u: u = t))))) AS same FROM n)
SELECT conv_id, turn, array_to_string(p, ' ') = array_to_string(g, ' ') AS em,
       round(CASE WHEN (array_to_string(p, ' ') IN ('yes', 'no', 'noanswer') OR array_to_string(g, ' ') IN ('yes', 'no', 'noanswer')) AND p <> g THEN 0 WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2.0::DOUBLE * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) END, 6) AS f1 FROM s""")
def txt28(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, d, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("p"))  # once for both roles
    pairs = turns.select("conv_id", "turn", "p", F.lead("p").over(w).alias("g")).where("g is not null")
    return pairs.select("conv_id", "turn", (F.col("p") == F.col("g")).alias("em"), F.round(T.normalized_f1(F.col("p"), F.col("g")), 6).alias("f1"))


@query("txt35_txt37_fnc01_keys", "SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS norm, sha256(text) AS cache_key, 'text_' || substr(sha256(source || '||' || '' || '||' || doc_id), 1, 16) AS node_id FROM documents")
def txt35(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(T.squeeze(F.col("text"))).alias("norm"), F.sha2("text", 256).alias("cache_key"), T.stable_id("text", F.col("source"), F.lit(None), F.col("doc_id")).alias("node_id"))


@query("evl03_evl04_relaxed_and_vote", """
SELECT event_id, CASE WHEN value >= g * 0.95 AND value <= g * 1.05 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relaxed,
       CASE WHEN value BETWEEN least(g * 0.95, g * 1.05) AND greatest(g * 0.95, g * 1.05) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS relaxed_strict,
       least(1.0::DOUBLE, (CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) / 3.0::DOUBLE) AS vote
FROM (SELECT *, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) - 5 AS g FROM events)""")
def evl03(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("g", F.coalesce(F.lag("value").over(w), F.lit(0.0)) - 5)
    a, g = F.concat(F.col("value").cast("string"), F.lit("%")), F.col("g").cast("string")
    return e.select("event_id", T.relaxed_match(a, g).alias("relaxed"), T.relaxed_match(a, g, strict=True).alias("relaxed_strict"), T.vote_match(F.col("event_type"), F.array(F.lit("view"), F.lit("view"), F.lit("click"))).alias("vote"))


@query("evl05_edit_similarity", """
SELECT page_id, round(greatest(CASE WHEN d1 < 0.5 THEN 1 - d1 ELSE 0 END, CASE WHEN d2 < 0.5 THEN 1 - d2 ELSE 0 END), 6) AS anls
FROM (SELECT page_id, levenshtein(a, b) / greatest(length(a), length(b)) AS d1, levenshtein(a, c) / greatest(length(a), length(c)) AS d2
      FROM (SELECT page_id, lower(url) AS a, lower(regexp_replace(url, '[0-9]', '', 'g')) AS b, lower(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)) AS c FROM pages))""")
def evl05(spark, d):
    """A page's whole address against its address without digits and its whole title."""
    golds = F.array(F.regexp_replace("url", "[0-9]", ""), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1))
    return table(spark, d, "pages").select("page_id", F.round(T.anls(F.col("url"), golds), 6).alias("anls"))


#: Texts that pages show in place of an article, and names that aren't articles.
MISSING = ("page not found", "does not have an article with this exact name", "没有找到")
NAMESPACES = ("special:", "talk:", "user:", "file:", "help:", "category:", "template:", "portal:")


@query("prj27_page_validity", "SELECT page_id, CASE WHEN trim(html) = '' THEN 'empty' WHEN " + " OR ".join(f"contains(lower(html), '{m}')" for m in MISSING) + " THEN 'missing' WHEN " + " OR ".join(f"starts_with(lower(t), '{n}')" for n in NAMESPACES) + " THEN 'namespace' ELSE 'ok' END AS status FROM (SELECT *, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t FROM pages)")
def prj27(spark, d):
    title, html = F.lower(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), F.lower("html")
    missing = F.lit(False)
    for m in MISSING:
        missing = missing | html.contains(m)
    other = F.lit(False)
    for n in NAMESPACES:
        other = other | title.startswith(n)
    return table(spark, d, "pages").select("page_id", F.when(F.trim("html") == "", "empty").when(missing, "missing").when(other, "namespace").otherwise("ok").alias("status"))


@query("prj28_image_gate", """
SELECT p_partkey, CASE WHEN p_size < 5 THEN 'rejected' WHEN p_size > 45 THEN 'rejected' ELSE 'accepted' END AS status,
       CASE WHEN p_size < 5 THEN 'width ' || CAST(p_size * 30 AS VARCHAR) || ' is under 120' WHEN p_size > 45 THEN 'content type text/html' ELSE 'ok' END AS reason FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)""")
def prj28(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size").cast("long") * 30).alias("width"), F.when(F.col("p_size") > 45, "text/html").otherwise("image/png").alias("kind"))
    bad = F.when(F.col("width") < 120 + 30, F.concat(F.lit("width "), F.col("width").cast("string"), F.lit(" is under 120"))).when(~F.col("kind").startswith("image/"), F.concat(F.lit("content type "), "kind"))
    return p.select("p_partkey", F.when(bad.isNull(), "accepted").otherwise("rejected").alias("status"), F.coalesce(bad, F.lit("ok")).alias("reason"))
