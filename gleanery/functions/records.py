"""Parsers of model output into records, and builders of graph records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import stable_id


def attribute_tags(text: Column, tag: str = "attr") -> Column:
    """array<struct<key, value>> of tags whose inside is ``key: value``, with an ASCII or a full-width colon; others are left out."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    cut = F.transform(found, lambda x: F.struct(F.trim(F.regexp_extract(x, r"(?s)^(.*?)[:\x{ff1a}](.*)$", 1)).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^(.*?)[:\x{ff1a}](.*)$", 2)).alias("value")))
    return F.filter(cut, lambda a: (a["key"] != "") & (a["value"] != ""))


def attribute_map(tags: Column) -> Column:
    """Tags as a map; of equal keys the last one stays."""
    keys = F.array_distinct(F.transform(tags, lambda t: t["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(tags, lambda t: t["key"] == k), -1)["value"]))


def fields(text: Column, *names: str) -> Column:
    """``name: value`` lines as a struct; null where a name is missing."""

    def one(n: str) -> Column:
        p = rf"(?im)^\s*{n}\s*[:\x{{ff1a}}]\s*(.*?)\s*$"
        return F.when(text.rlike(p), F.regexp_extract(text, p, 1)).alias(n)

    return F.struct(*map(one, names))


def paired(text: Column, first: str, second: str) -> Column:
    """Tags of two names side by side, as many as the rarer one has."""
    a, b = (F.regexp_extract_all(text, F.lit(rf"(?s)<{t}>(.*?)</{t}>"), F.lit(1)) for t in (first, second))
    n = F.least(F.size(a), F.size(b))
    zipped = F.arrays_zip(F.transform(a, lambda x: F.trim(x)).alias(first), F.transform(b, lambda x: F.trim(x)).alias(second))
    return F.slice(zipped, F.lit(1), n)


def listed(text: Column, separator: str = r"\|") -> Column:
    """Names between separators, trimmed, once each, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != ""))


def page_node(url: Column, title: Column, summary: Column, run: Column) -> Column:
    """The node of an encyclopedia page; its id is that of its address."""
    source = F.struct(F.lit("web").alias("source_type"), url.alias("url"), run.alias("run_id"))
    return F.struct(stable_id("text", F.lit("wikipedia_page"), url).alias("node_id"), F.lit("text").alias("node_type"), F.lit("wikipedia_page").alias("subtype"), title.alias("title"), summary.alias("summary"), source.alias("source"))


def edge(src: Column, dst: Column, kind: str, relation: Column, evidence: Column) -> Column:
    """An edge; its id is that of its ends, kind, relation and evidence."""
    return F.struct(stable_id("edge", src, dst, F.lit(kind), relation, evidence).alias("edge_id"), src.alias("src_node_id"), dst.alias("dst_node_id"), F.lit(kind).alias("edge_type"), relation.alias("relation"))


def evidence_key(*parts: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*(F.nullif(p.cast("string"), F.lit("")) for p in parts))


def summary_line(step: Column, action: Column, result: Column, most: int = 200) -> Column:
    return F.concat(F.lit("step "), step.cast("string"), F.lit(": "), action, F.lit(" -> "), F.left(result, F.lit(most)))


def training_row(source: str, question: Column, answer: Column, ability: str, **extra: Column) -> Column:
    """A trainer's row: prompt, rule reward with its truth, and what else is known."""
    return F.struct(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), question.alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), answer.alias("ground_truth")).alias("reward_model"),
        F.struct(*(c.alias(k) for k, c in extra.items())).alias("extra_info") if extra else F.lit(None).cast("struct<none: string>").alias("extra_info"),
    )


def difficulty(label: Column) -> Column:
    """Levels by name or number; null for unknown ones."""
    names = {"easy": 1, "introductory": 1, "medium": 2, "interview": 2, "hard": 3, "competition": 3}
    low = F.lower(F.trim(label))
    return F.coalesce(*(F.when(low == k, v) for k, v in names.items()), F.regexp_extract(low, r"(\d+)", 1).try_cast("int"))
