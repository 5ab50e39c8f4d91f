"""Operators of property graphs: edges from pages, degrees, components, levels, layout, linking of labels to nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import entity_label
from gleanery.operators.components import components
from gleanery.storage import materialize

#: Levels that are written into one table.
LEVELS_A_TABLE = 64
LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>"""


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, rank (from 1), href, anchor of each link of a page, in order."""
    hrefs = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(1))
    anchors = F.regexp_extract_all(html_col, F.lit(LINK), F.lit(2))
    links = pages.select(F.col(id_col).alias("page_id"), F.posexplode(F.arrays_zip(hrefs.alias("href"), anchors.alias("anchor"))).alias("rank", "l"))
    return links.select("page_id", (F.col("rank") + 1).alias("rank"), F.col("l")["href"].alias("href"), F.col("l")["anchor"].alias("anchor"))


def parallel_edges(edges: DataFrame, src: str, dst: str, kind: str, label: str, order: str) -> DataFrame:
    """One row for each (src, dst, kind): how many edges, and their distinct labels in order of first appearance."""
    firsts = edges.groupBy(src, dst, kind, label).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    pairs = F.array_sort(F.collect_list(F.struct("_at", F.col(label).alias("label"))))
    return firsts.groupBy(src, dst, kind).agg(F.sum("_n").alias("n"), F.transform(pairs, lambda p: p["label"]).alias("labels"))


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """In and out degrees over edges whose both ends are nodes; nodes without any have 0."""
    ids = nodes.select(F.col(node))
    known = edges.join(ids.select(F.col(node).alias(src)), src, "left_semi").join(ids.select(F.col(node).alias(dst)), dst, "left_semi")
    ends = known.select(F.col(src).alias(node), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(known.select(F.col(dst).alias(node), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ids.select(node, F.lit(0).alias("o"), F.lit(0).alias("i")).unionAll(ends).groupBy(node).agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges and their ratios, 0 where a ratio is undefined."""
    n, m = nodes.agg(F.count("*").cast("double").alias("n")), edges.agg(F.count("*").cast("double").alias("m"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n_, m_ = F.col("n"), F.col("m")
    return n.crossJoin(m).select(n_.cast("long").alias("nodes"), m_.cast("long").alias("edges"), zero(F.try_divide(m_, n_)).alias("edges_per_node"), zero(F.try_divide(2 * m_, n_)).alias("mean_degree"), zero(F.try_divide(m_, n_ * (n_ - 1))).alias("directed_density"), zero(F.try_divide(2 * m_, n_ * (n_ - 1))).alias("undirected_density"))


def connected(nodes: DataFrame, edges: DataFrame, node: str = "node", src: str = "src", dst: str = "dst") -> DataFrame:
    """node and component (the smallest id it reaches) of each node; ids are longs."""
    top = components(edges, src, dst)
    return nodes.select(node).join(top.select(F.col("node").alias(node), "component"), node, "left").select(node, F.coalesce("component", node).alias("component"))


def levels(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", most: int | None = None) -> DataFrame:
    """node and level (undirected hops from the nearest root), by a frontier a round.

    Only the frontier meets the edges. Neighbours of a level lie in it, in the
    one before or in the next, so an anti-join with these two cuts out what was
    reached. Rounds end with an empty frontier; a node beyond ``most`` is an error.
    """
    both = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("to")).unionAll(edges.select(F.col(dst).alias("node"), F.col(src).alias("to"))).distinct(), "levels-edges")
    front = behind = materialize(roots.select("node", F.lit(0).alias("level")).distinct(), "levels-seen")
    done, fronts, level = [], [front], 0
    while True:
        level += 1
        near = front.select("node").unionAll(behind.select("node"))
        ahead = materialize(front.join(both, "node").select(F.col("to").alias("node")).distinct().join(near, "node", "left_anti").select("node", F.lit(level).alias("level")), "levels-front")
        if ahead.isEmpty():
            return reduce(DataFrame.unionAll, [*done, *fronts])
        if most is not None and level > most:
            raise RuntimeError(f"nodes lie more than {most} hops from the nearest root")
        behind, front = front, ahead
        fronts.append(ahead)
        if len(fronts) >= LEVELS_A_TABLE:  # so that the plan of a long chain stays small
            done, fronts = [*done, materialize(reduce(DataFrame.unionAll, fronts), "levels-seen")], []


def component_roots(members: DataFrame) -> DataFrame:
    """Of each component the node of least (indegree, -outdegree, order)."""
    return members.groupBy("component").agg(F.min_by("node", F.struct("indegree", -F.col("outdegree"), "node")).alias("root"))


def layout(members: DataFrame) -> DataFrame:
    """x and y of nodes (component, level, degrees): a column for each level, rows by (indegree, -outdegree, node)."""
    w = Window.partitionBy("component", "level").orderBy("indegree", F.desc("outdegree"), "node")
    return members.select("node", "component", (F.col("level") * 220).alias("x"), ((F.row_number().over(w) - 1) * 90).alias("y"))


def link_labels(labels: DataFrame, nodes: DataFrame, label: str = "label", node: str = "node", names: str = "names") -> DataFrame:
    """node_match of each label: the one node with an equal name or alias, else the one node whose words hold all words of a label of 4 characters or more; null if none or several.

    Both rules are equi-joins: on the whole normalised name, and on single words
    with a count of the words that met.
    """
    wanted = labels.select(label).distinct().withColumn("_key", entity_label(F.col(label))).where("_key <> ''")
    known = nodes.select(node, F.explode(names).alias("_name")).select(node, entity_label(F.col("_name")).alias("_key")).where("_key <> ''").distinct()
    equal = wanted.join(known, "_key").groupBy(label).agg(F.count_distinct(node).alias("_n"), F.min(node).alias("_hit"), F.collect_set(node).alias("_all"))
    words = wanted.where("length(_key) >= 4").select(label, "_key", F.explode(F.array_distinct(F.split("_key", " "))).alias("_w"))
    sizes = words.groupBy(label).agg(F.count("*").alias("_size"))
    held = known.select(node, F.col("_key").alias("_full"), F.explode(F.array_distinct(F.split("_key", " "))).alias("_w"))
    met = words.join(held, "_w").where("_key <> _full").groupBy(label, node, "_full").agg(F.count("*").alias("_m")).join(sizes, label).where("_m = _size")
    exact = wanted.join(known, "_key").select(label, F.col(node).alias("_x")).distinct()
    part = met.join(exact.withColumnRenamed("_x", node), [label, node], "left_anti").groupBy(label).agg(F.count_distinct(node).alias("_pn"), F.min(node).alias("_phit"))
    out = labels.join(equal.select(label, "_n", "_hit"), label, "left").join(part, label, "left")
    return out.select(*labels.columns, F.coalesce(F.when(F.col("_n") == 1, F.col("_hit")), F.when(F.col("_pn") == 1, F.col("_phit"))).alias("node_match"))


def diverse_links(links: DataFrame, page: list[str], score: str, rank: str, position: str, window: int = 1200, per_window: int = 2, early: int = 3000, early_per_window: int = 4, gap: int = 500, cap: int = 80) -> DataFrame:
    """Links accepted greedily by score and rank: a window of text takes so many, and each stands ``gap`` characters from all accepted ones.

    A fold over each page's sorted links, whose state is the accepted ones (``cap`` at most).
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(rank).alias("r"), F.col(position).alias("p"), F.struct(*[c for c in links.columns if c not in page]).alias("row"))))
    grouped = links.groupBy(*page).agg(rows.alias("l"))

    def step(acc: Column, e: Column) -> Column:
        same = F.size(F.filter(acc, lambda a: F.floor(a["p"] / window) == F.floor(e["p"] / window)))
        room = same < F.when(e["p"] < early, early_per_window).otherwise(per_window)
        far = F.forall(acc, lambda a: F.abs(a["p"] - e["p"]) >= gap)
        return F.when((F.size(acc) < cap) & room & far, F.concat(acc, F.array(e))).otherwise(acc)

    taken = F.aggregate("l", F.slice("l", 1, 0), step)
    return grouped.select(*page, F.explode(taken).alias("e")).select(*page, "e.row.*")


def expand(pages: DataFrame, edges: DataFrame, seeds: DataFrame, max_depth: int, max_new: int) -> DataFrame:
    """Bounded traversal: node, depth and order of visit from ``seeds``; of a page the first ``max_new`` links by rank count, and each node is queued once.

    ``pages`` has node; ``edges`` src, rank, dst. A round is one depth; a
    node's order is that of its first queuing (order of parent, then rank).
    """
    known = materialize(pages.select("node").distinct(), "expand-pages")
    first = materialize(edges.where(F.col("rank") <= max_new).join(known.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "rank", "dst"), "expand-edges")
    front = materialize(seeds.join(known, "node", "left_semi").select("node", F.lit(0).alias("depth"), F.array(F.col("node").cast("long")).alias("visit")), "expand-front")
    seen = front
    for depth in range(1, max_depth + 1):
        reached = front.select(F.col("node").alias("src"), "visit").join(first, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.concat("visit", F.array(F.col("rank").cast("long")))).alias("visit"))
        front = materialize(reached.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "visit"), "expand-front")
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen
