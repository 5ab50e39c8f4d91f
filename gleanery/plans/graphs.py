"""Queries of the page graph: pages, the paths that they link to, and what follows from these edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import stable_id
from gleanery.operators import graph as G
from gleanery.operators.datasets import with_position
from gleanery.plans.registry import query, table
from gleanery.storage import materialize

LINKS_SQL = f"""
SELECT page_id, r AS rank, hrefs[r] AS href, anchors[r] AS anchor FROM (
  SELECT page_id, hrefs, anchors, unnest(range(1, len(hrefs) + 1)) AS r FROM (
    SELECT page_id, regexp_extract_all(html, '{G.LINK}', 1) AS hrefs, regexp_extract_all(html, '{G.LINK}', 2) AS anchors FROM pages))
"""


def _links(spark, d) -> DataFrame:
    return G.page_links(table(spark, d, "pages"))


@query("fnc06_page_links", f"SELECT page_id, CAST(rank AS INT) AS rank, href, anchor FROM ({LINKS_SQL})")
def fnc06(spark, d):
    return _links(spark, d)


@query("agg01_parallel_edges", f"SELECT page_id, href, list_aggregate(list_transform(list_sort(list(DISTINCT x)), lambda p: p[2]), 'string_agg', '|') AS labels, max(n) AS n FROM (SELECT page_id, href, [lpad(CAST(min(rank) OVER (PARTITION BY page_id, href, anchor) AS VARCHAR), 9, '0'), anchor] AS x, count(*) OVER (PARTITION BY page_id, href) AS n FROM ({LINKS_SQL})) GROUP BY page_id, href")
def agg01(spark, d):
    e = G.parallel_edges(_links(spark, d).withColumn("kind", F.lit("web_link")), "page_id", "href", "kind", "anchor", "rank")
    return e.select("page_id", "href", F.array_join("labels", "|").alias("labels"), "n")


#: A page's node id is twice its number; a linked path's is twice the page of smallest number that links to it, plus one.
GRAPH_SQL = f"""
l AS ({LINKS_SQL}), t AS (SELECT href, min(page_id) * 2048 + min(rank) * 2 + 1 AS dst FROM (SELECT href, page_id, rank, row_number() OVER (PARTITION BY href ORDER BY page_id, rank) AS k FROM l) WHERE k = 1 GROUP BY href),
e AS (SELECT DISTINCT l.page_id * 2048 AS src, t.dst FROM l JOIN t USING (href)),
n AS (SELECT page_id * 2048 AS node FROM pages UNION SELECT dst FROM t)
"""
#: Links of a page that have such numbers; the SQL has no others, and numbers paths of later links as those of the next page.
RANKS = 1024


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    links = _links(spark, d)
    first = materialize(links.groupBy("href").agg(F.min(F.struct("page_id", "rank")).alias("f")).select("href", "f.page_id", "f.rank"), "graph-paths")
    wide = first.where(F.col("rank") > RANKS)
    number = F.col("page_id") * 2048 + F.col("rank") * 2 + 1
    if wide.isEmpty():
        first = first.select("href", number.alias("dst"))
    else:  # even numbers between those of pages, as many as it takes
        pos = F.col("pos")
        beyond = materialize(with_position(wide, ["rank", "page_id", "href"]).select("href", (F.floor(pos / (RANKS - 1)) * 2048 + (pos % (RANKS - 1) + 1) * 2).alias("dst")), "graph-paths")
        first = first.where(F.col("rank") <= RANKS).select("href", number.alias("dst")).unionAll(beyond)
    edges = links.join(first, "href").select((F.col("page_id") * 2048).alias("src"), "dst").distinct()
    nodes = table(spark, d, "pages").select((F.col("page_id") * 2048).alias("node")).union(first.select("dst")).distinct()
    return nodes, edges


@query("agg02_degrees", f"WITH {GRAPH_SQL} SELECT node, CAST((SELECT count(*) FROM e WHERE dst = node) AS BIGINT) AS indegree, CAST((SELECT count(*) FROM e WHERE src = node) AS BIGINT) AS outdegree FROM n")
def agg02(spark, d):
    return G.degrees(*_graph(spark, d))


@query("agg03_density", f"""WITH {GRAPH_SQL}, c AS (SELECT (SELECT count(*) FROM n) AS n, (SELECT count(*) FROM e) AS m)
SELECT n AS nodes, m AS edges, m / n AS edges_per_node, 2 * m / n AS mean_degree, m / (n * (n - 1)) AS directed_density, 2 * m / (n * (n - 1)) AS undirected_density FROM c""")
def agg03(spark, d):
    return G.density(*_graph(spark, d))


@query("set13_connected_components", f"""WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e UNION SELECT node, node FROM n),
r(node, reach) AS (SELECT node, node FROM n UNION SELECT r.node, b.b FROM r JOIN b ON r.reach = b.a WHERE b.b < r.node OR b.b > r.node)
SELECT node, min(reach) AS component FROM r GROUP BY node""")
def set13(spark, d):
    return G.connected(*_graph(spark, d))


@query("set14_levels", f"""WITH RECURSIVE {GRAPH_SQL}, b AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
r(node, level) AS (SELECT 0, 0 UNION SELECT b.b, r.level + 1 FROM r JOIN b ON r.node = b.a WHERE r.level < 12)
SELECT CAST(node AS BIGINT) AS node, CAST(min(level) AS INT) AS level FROM r GROUP BY node""")
def set14(spark, d):
    _, edges = _graph(spark, d)
    return G.levels(edges, spark.range(1).select(F.col("id").alias("node")))


@query("set15_srt06_layout")
def set15(spark, d):
    """Roots, levels and places of every component."""
    nodes, edges = _graph(spark, d)
    members = G.connected(nodes, edges).join(G.degrees(nodes, edges), "node")
    roots = G.component_roots(members)
    reached = G.levels(edges, roots.select(F.col("root").alias("node")))
    return G.layout(members.join(reached, "node"))


@query("set16_bounded_expansion")
def set16(spark, d):
    """Pages as nodes, linked when one's address path ends with a word that the other links to."""
    nodes, edges = _graph(spark, d)
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    from pyspark.sql import Window

    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    return G.expand(nodes, ranked, spark.range(1).select(F.col("id").alias("node")), max_depth=3, max_new=4).select("node", "depth", F.array_join(F.transform("visit", lambda v: v.cast("string")), "/").alias("visit"))


@query("srt03_candidate_cap", f"""
SELECT page_id, href, CAST(r AS INT) AS place FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY rank) AS r FROM (SELECT *, row_number() OVER (PARTITION BY page_id, href ORDER BY rank) AS k FROM ({LINKS_SQL}) WHERE length(anchor) > 2) WHERE k = 1) WHERE r <= 4""")
def srt03(spark, d):
    """The first four distinct targets with a positive score, in rank order: a target counts as seen once it has one."""
    from pyspark.sql import Window

    firsts = _links(spark, d).where(F.length("anchor") > 2).groupBy("page_id", "href").agg(F.min("rank").alias("rank"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("rank"))).where("place <= 4").select("page_id", "href", "place")


@query("win22_diverse_links")
def win22(spark, d):
    """Links of a page that stand apart in it; longer anchors score higher."""
    links = G.page_links(table(spark, d, "pages")).withColumn("score", F.length("anchor").cast("double")).withColumn("pos", F.col("rank") * 260)
    return G.diverse_links(links, ["page_id"], "score", "rank", "pos").select("page_id", "href", "rank", "score")


@query("joi02_entity_linking")
def joi02(spark, d):
    """Anchors linked to page titles, exactly or by their words."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("node"), F.array(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)).alias("names"))
    labels = _links(spark, d).select(F.col("anchor").alias("label")).distinct()
    return G.link_labels(labels, pages)


@query("joi05_edge_materialisation", f"""WITH l AS ({LINKS_SQL}), s AS (SELECT page_id, regexp_extract(url, '/([^/?#]*)[^/]*$', 1) AS name, url FROM pages)
SELECT l.page_id, l.href, 'edge_' || substr(sha256(p.url || '||' || l.href || '||web_link||' || l.anchor || '||'), 1, 16) AS edge_id FROM l JOIN pages p USING (page_id)""")
def joi05(spark, d):
    links = _links(spark, d).join(table(spark, d, "pages").select("page_id", "url"), "page_id")
    return links.select("page_id", "href", stable_id("edge", F.col("url"), F.col("href"), F.lit("web_link"), F.col("anchor"), F.lit(None)).alias("edge_id"))


#: Edge types by the kinds of their ends; other pairs allow ``derived`` alone. Fixed values.
EDGE_TYPES = {
    ("text", "text"): "wiki_link wiki_attribute web_link search_retrieved evidence_supports derived",
    ("text", "image"): "search_retrieved image_source_page evidence_supports derived",
    ("image", "text"): "image_source_page image_depicts search_retrieved evidence_supports derived",
    ("image", "image"): "visually_similar search_retrieved derived",
    ("image", "region"): "image_contains_region",
    ("region", "text"): "region_identifies region_has_text evidence_supports derived",
    ("region", "image"): "search_retrieved visually_similar derived",
}


@query("fnc03_edge_type_validation", "SELECT l_linestatus, l_returnflag, count(*) AS n, bool_and(ok) AS allowed FROM (SELECT l_linestatus, l_returnflag, CASE WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN true ELSE l_returnflag = 'A' END AS ok FROM lineitem) GROUP BY ALL")
def fnc03(spark, d):
    """Line items as edges: status O is a text, F a region end; flags are edge types."""
    rows = [(s, t, e) for (s, t), es in EDGE_TYPES.items() for e in es.split()]
    allowed = spark.createDataFrame(rows, "src string, dst string, kind string")
    kind = F.when(F.col("l_returnflag") == "N", "web_link").when(F.col("l_returnflag") == "A", "derived").otherwise("image_depicts")
    edges = table(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.when(F.col("l_linestatus") == "O", "text").otherwise("audio").alias("src"), F.lit("text").alias("dst"), kind.alias("kind"))
    met = edges.join(F.broadcast(allowed.withColumn("hit", F.lit(True))), ["src", "dst", "kind"], "left")  # a fixed table of 23 rows
    return met.groupBy("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("hit", F.col("kind") == "derived")).alias("allowed"))


@query("txt09_txt12_scored_links")
def txt09(spark, d):
    """Pages' anchors as markdown links to articles, found, resolved and scored."""
    from gleanery.functions import links as L

    text = F.regexp_replace("html", G.LINK, "[$2](/wiki$1)")
    pages = table(spark, d, "pages").select("page_id", text.alias("md"), F.lit("https://en.wikipedia.org/wiki/Home").alias("url"))
    found = L.page_links(pages, "page_id", "md", "url").where("url is not null")
    s = L.link_score(F.substring_index("url", "/wiki/", -1), F.col("anchor"), F.col("context"), F.col("rank"))
    return found.select(F.col("id").alias("page_id"), "rank", "url", s.alias("s")).select("page_id", "rank", "url", F.col("s.score").alias("score"), F.array_join("s.reasons", ",").alias("reasons"))
