"""Recorded search results and parsed records against values worked out by hand."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from gleanery.functions import records as R
from gleanery.operators import search as S


def test_hits(spark):
    raw = json.dumps({"organic": [{"title": "ad", "link": "u0", "type": "ad"}, {"title": "<b>A</b> x", "url": "u1", "description": "d"}, {"title": "B", "link": "u2", "rank": "9", "snippet": "s"}]})
    got = S.hits(spark.createDataFrame([("q", raw)], "query string, raw string")).orderBy("position").collect()
    assert [(r.position, r.title, r.url, r.snippet) for r in got] == [(2, "A x", "u1", "d"), (9, "B", "u2", "s")]
    text = S.rendered(S.hits(spark.createDataFrame([("q", raw)], "query string, raw string")).withColumn("content", F.lit("")), "query").first().text
    assert text == "[2] A x\nd\n=======\n[9] B\ns"


def test_candidates(spark):
    rows = [(1, i, f"u{i % 3}.png", "p", "t", 200 if i else 50, None, "image/png") for i in range(6)] + [(1, 9, "x.svg?a", "p", "t", None, None, None)]
    df = spark.createDataFrame(rows, "plan int, n int, url string, page string, title string, width int, height int, kind string")
    got = {r.n: (r.verdict.status, r.verdict.reason) for r in S.candidates(df, "plan", ["n"], cap=1).collect()}
    assert got == {0: ("rejected", "width 50 is under 120"), 1: ("accepted", "ok"), 9: ("rejected", "vector image")}


def test_fallback_and_queries(spark):
    a = spark.createDataFrame([("q1", "x")], "query string, u string")
    b = spark.createDataFrame([("q1", "y"), ("q2", "z")], "query string, u string")
    assert sorted(r.u for r in S.with_fallback(a, b, "query").collect()) == ["x", "z"]
    q = spark.createDataFrame([(1, "a b", 0, "T u"), (1, "A B", 1, "T u"), (1, "t U", 2, "T u"), (1, "one", 3, "T u"), (1, "c d", 4, "T u")], "node int, q string, o int, title string")
    assert sorted(r.q for r in S.unique_queries(q, "node", "q", "o", "title").collect()) == ["a b", "c d"]


def test_judged_links(spark):
    links = spark.createDataFrame([(1, "a", 2.0, 1), (1, "b", 1.0, 2), (2, "c", 1.0, None)], "page int, url string, score double, rank int")
    verdicts = spark.createDataFrame([(1, "a", True), (2, "c", False)], "page int, url string, kept boolean")
    assert sorted(r.url for r in S.judged_links(links, verdicts, "page", "url").collect()) == ["a", "c"]


def test_records(spark):
    t = F.lit("<attr>k: v</attr><attr>bad</attr><attr>k：w</attr>")
    r = spark.range(1).select(R.attribute_map(R.attribute_tags(t)).alias("m"), R.fields(F.lit("name: x\nScore : 3"), "name", "score", "none").alias("f"), R.paired(F.lit("<q>a</q><r>1</r><q>b</q>"), "q", "r").alias("p"), R.listed(F.lit("a| b||a")).alias("l"), R.evidence_key(F.lit(None).cast("string"), F.lit(""), F.lit("z")).alias("e"), R.difficulty(F.lit("Level 4")).alias("d"), S.numbered_passages(F.lit("a  b\n\n\nccc"), most_chars=2).alias("n")).first()
    assert r.m == {"k": "w"} and tuple(r.f) == ("x", "3", None) and [tuple(x) for x in r.p] == [("a", "1")]
    assert (r.l, r.e, r.d, r.n) == (["a", "b"], "z", 4, "P1: a  ...\nP2: cc ...")
