"""Operators of recorded search results: ranks, dedupe before the gate, caps, fallbacks, rendering, judged links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import strip_html

HIT = "struct<title: string, link: string, url: string, snippet: string, description: string, rank: string, position: struct<absolute: int>, type: string>"


def hits(responses: DataFrame, query: str = "query", raw: str = "raw", field: str = "organic") -> DataFrame:
    """query, position, title, url, snippet of a recorded response's hits; advertisements and images are left out, and a position without a rank is that among all hits."""
    rows = responses.select(query, F.posexplode(F.from_json(F.get_json_object(raw, f"$.{field}"), f"array<{HIT}>")).alias("i", "h"))
    h = F.col("h")
    place = F.coalesce(h["rank"].try_cast("int"), h["position"]["absolute"], F.col("i") + 1)
    url = F.coalesce(F.nullif(h["link"], F.lit("")), F.nullif(h["url"], F.lit("")))
    text = F.coalesce(F.nullif(h["snippet"], F.lit("")), h["description"], F.lit(""))
    kept = rows.where(~F.coalesce(h["type"], F.lit("organic")).isin("ad", "image"))
    return kept.select(query, place.alias("position"), strip_html(F.coalesce(h["title"], F.lit(""))).alias("title"), url.alias("url"), strip_html(text).alias("snippet")).where("url is not null")


def image_verdict(url: Column, width: Column, height: Column, kind: Column, least: int = 120) -> Column:
    """struct(status, reason): the first ground to reject an image; unknown sizes pass."""
    bad = (
        F.when(F.coalesce(url, F.lit("")) == "", "no url")
        .when(F.lower(F.regexp_replace(url, r"[?#].*$", "")).endswith(".svg"), "vector image")
        .when(width < least, F.concat(F.lit("width "), width.cast("string"), F.lit(f" is under {least}")))
        .when(height < least, F.concat(F.lit("height "), height.cast("string"), F.lit(f" is under {least}")))
        .when(~F.coalesce(kind, F.lit("image/")).startswith("image/"), F.concat(F.lit("content type "), kind))
    )
    return F.struct(F.when(bad.isNull(), "accepted").otherwise("rejected").alias("status"), F.coalesce(bad, F.lit("ok")).alias("reason"))


def candidates(images: DataFrame, plan: str, order: list[str], cap: int = 8) -> DataFrame:
    """Images of each plan: the first of each key (url, else page, else title) over all queries and engines, then the gate, then the ``cap`` first accepted ones (the cap is the feature)."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.nullif("page", F.lit("")), "title")
    first = Window.partitionBy(plan, "_key").orderBy(*order)
    d = images.withColumn("_key", key).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    d = d.withColumn("verdict", image_verdict(F.col("url"), F.col("width"), F.col("height"), F.col("kind")))
    take = F.sum((F.col("verdict.status") == "accepted").cast("int")).over(Window.partitionBy(plan).orderBy(*order))
    return d.withColumn("_a", take).where((F.col("verdict.status") == "rejected") | (F.col("_a") <= cap)).drop("_key", "_n", "_a")


def with_fallback(primary: DataFrame, secondary: DataFrame, query: str, least: int = 1) -> DataFrame:
    """A query's primary hits, or the secondary ones where these are fewer than ``least``."""
    enough = primary.groupBy(query).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(query)
    return primary.join(enough, query, "left_semi").unionByName(secondary.join(enough, query, "left_anti"))


def unique_queries(queries: DataFrame, node: str, text: str, order: str, title: str, least_words: int = 2, cap: int = 6) -> DataFrame:
    """Each node's queries, once in any case, not its title, of ``least_words`` or more; the first ``cap``."""
    w = Window.partitionBy(node).orderBy(order)
    kept = queries.where((F.lower(text) != F.lower(title)) & (F.size(F.split(F.trim(text), r"\s+")) >= least_words))
    firsts = kept.withColumn("_k", F.lower(F.trim(text))).withColumn("_n", F.row_number().over(Window.partitionBy(node, "_k").orderBy(order))).where("_n = 1")
    return firsts.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_k", "_n", "_r")


def numbered_passages(text: Column, most: int = 80, most_chars: int = 1200) -> Column:
    """Paragraphs squeezed, cut and numbered P1, P2, ..."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    cut = F.transform(F.slice(parts, 1, most), lambda p, i: F.concat(F.lit("P"), (i + 1).cast("string"), F.lit(": "), F.when(F.length(p) > most_chars, F.concat(F.left(p, F.lit(most_chars)), F.lit(" ..."))).otherwise(p)))
    return F.array_join(cut, "\n")


def judged_links(links: DataFrame, verdicts: DataFrame, page: str, key: str, most: int = 40) -> DataFrame:
    """Of the ``most`` best links of a page those that a recorded judge kept; all links if it kept none."""
    w = Window.partitionBy(page).orderBy(F.desc("score"), F.col("rank").isNull(), "rank")
    d = links.withColumn("_r", F.row_number().over(w)).join(verdicts.select(page, key, F.col("kept").alias("_k")), [page, key], "left")
    kept = F.coalesce("_k", F.lit(False)) & (F.col("_r") <= most)
    any_ = F.bool_or(kept).over(Window.partitionBy(page))
    return d.withColumn("_kept", kept).withColumn("_any", any_).where("_kept or not _any").drop("_r", "_k", "_kept", "_any")


def rendered(hit_rows: DataFrame, query: str, gap: str = "\n=======\n") -> DataFrame:
    """One text per query: its hits in order, the page's content or else the snippet under each title."""
    one = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), "title", F.lit("\n"), F.coalesce(F.nullif("content", F.lit("")), "snippet"))
    parts = F.array_sort(F.collect_list(F.struct("position", one.alias("t"))))
    return hit_rows.groupBy(query).agg(F.array_join(F.transform(parts, lambda p: p["t"]), gap).alias("text"))


def page_of(rows: DataFrame, order: list[str], limit: int, page: int = 1) -> DataFrame:
    """Rows of one result page; limits are held to 1..100."""
    n = max(1, min(100, limit))
    return rows.orderBy(*order).offset((page - 1) * n).limit(n)
