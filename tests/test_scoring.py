"""Links, scores and overlap measures against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.functions import links as L
from gleanery.functions import scoring as S


def test_links_of_a_text(spark):
    texts = {
        "![i](x) [a](/wiki/B_(c)) [b] (no) [c](u\\)v) [d](open": [("a", "/wiki/B_(c)", 8, 24), ("c", "u\\)v", 34, 43)],
        "[a]()[b](c)": [("a", "", 0, 5), ("b", "c", 5, 11)],
        "x [a](b\n(c(d)e)) é [[f](g)": [("a", "b\n(c(d)e)", 2, 16), ("[f", "g", 19, 26)],
        "[a](b(c) [d](e)": [],
        "![a](b) [a](b)": [("a", "b", 8, 14)],
        "": [],
        "no links ] ( [": [],
        "[one](" + "y" * 5000 + ")": [("one", "y" * 5000, 0, 5007)],
    }
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.links_in(F.col("t")).alias("l")).collect()
    assert {r.t: [tuple(x) for x in r.l] for r in rows} == texts


@pytest.mark.parametrize(
    ("target", "source", "want"),
    [
        ("/wiki/Caf%C3%A9#x", "https://fr.wikipedia.org/wiki/A", "https://fr.wikipedia.org/wiki/Caf%C3%A9"),
        ("<https://en.wikipedia.org/wiki/A b>", "", "https://en.wikipedia.org/wiki/A%20b"),
        ("#top", "", None),
        ("https://example.com/wiki/A", "", None),
        (' /wiki/A_(b),c:d "title"', None, "https://en.wikipedia.org/wiki/A_(b),c:d"),
        ("http://de.wikipedia.org/wiki/Ü+x?y=1#z", "", "https://de.wikipedia.org/wiki/%C3%9C%2Bx"),
        ("/wiki/100%", "", "https://en.wikipedia.org/wiki/100%25"),
        ("/wiki/a*b~c", "//x.org/", "https://x.org/wiki/a%2Ab~c"),
        ("/other/A", "", None),
    ],
)
def test_article_addresses(spark, target, source, want):
    row = spark.createDataFrame([(target, source)], "t string, s string").select(L.article_address(F.col("t"), F.col("s")).alias("u")).first()
    assert row.u == want


def test_page_links_and_scores(spark):
    pages = spark.createDataFrame([(1, "see [Ada Lovelace](/wiki/Ada_Lovelace) who won", "https://en.wikipedia.org/wiki/X"), (2, None, None)], "k long, t string, u string")
    rows = L.page_links(pages, "k", "t", "u")
    r = rows.withColumn("s", L.link_score(F.lit("Ada Lovelace"), F.col("anchor"), F.col("context"), F.col("rank"))).collect()
    assert len(r) == 1 and r[0].url.endswith("/Ada_Lovelace") and r[0].s.score == pytest.approx(4.5)
    low = spark.range(1).select(L.link_score(F.lit("1984"), F.lit("x1"), F.lit(""), F.lit(1)).alias("a"), L.link_score(F.lit("IMDb"), F.lit("x1"), F.lit(""), F.lit(1)).alias("b"), L.link_score(F.lit("Q"), F.lit("here"), F.lit(""), F.lit(1)).alias("c")).first()
    assert [low.a.reasons, low.b.reasons, low.c.reasons] == [["year_or_date_title"], ["generic_title"], ["low_value_anchor"]]


@pytest.mark.parametrize(("a", "b"), [("\\frac12", "\\frac{1}{2}"), ("0.5", "1/2"), ("\\dfrac{3}{4}", "\\tfrac{3}{4}"), ("x=5", "5"), ("10\\%", "10"), (".25", "0.25"), ("\\sqrt3", "\\sqrt{3}"), ("5\\text{ cm}", "5"), ("90^\\circ", "90")])
def test_math_forms(a, b):
    assert S.math_form(a) == S.math_form(b)


def test_boxed_and_countdown():
    assert S.last_boxed("a \\boxed{1} b \\boxed{x{y}}") == "\\boxed{x{y}}" and S.last_boxed("\\boxed{1") is None
    assert S.countdown("(1+2)*3/1-4", [1, 2, 3, 1, 4], 5) == 1 and S.countdown("1+2", [1, 3], 3) == 0.1 and S.countdown("import os", [], 1) == 0
    assert S._evaluate("8/4/2") == 1 and S._evaluate("2-(3-4)*-1") == 1 and S._evaluate("1/0") is None and S._evaluate("1+") is None


def test_scores(spark):
    arr = F.array(F.lit("The Cat"))
    r = spark.range(1).select(
        S.tag_score(F.lit("<answer>no</answer><answer> cat.</answer>"), arr).alias("a"), S.tag_score(F.lit("none"), arr).alias("b"), S.tag_score(F.lit("<answer>a cat sat</answer>"), arr, part=True).alias("c"), S.tag_score(F.lit("<answer>cat</answer>" * 11), arr).alias("d"),
        S.routed(F.lit("gsm8k"), F.lit("so #### 12"), F.lit("12")).alias("e"), S.overlong_penalty(F.lit(950), 1000, 100).alias("f"), S.overlong_penalty(F.lit(10), 1000, 100).alias("g"), S.math_equal()(F.lit("\\frac12"), F.lit("1/2")).alias("h"), S.overlap_scores()(F.lit("abcd"), F.lit("abcd")).alias("i"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (1, 0, 1, 0.25, 1, -0.5, 0, True)
    assert tuple(r.i) == (100, 100, 100, 100)
    with pytest.raises(ValueError):
        S.route("gsm8k")(lambda a, b: a)
