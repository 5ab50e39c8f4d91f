"""Encoders, masks, open answers and splits against values worked out by hand, and the queries' SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import batches as B
from gleanery.operators import recipes as R


def test_encoded_turns(spark):
    turns = [([1, 2, 3], [4, 5]), ([6], [7, 8, 9, 10])]
    df = spark.createDataFrame([(turns,)], "t array<struct<source: array<long>, target: array<long>>>")
    one = lambda **k: df.select(R.encoded_turns(F.col("t"), **k).alias("r")).first().r
    assert one(budget=100)[:] == ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [-100, -100, -100, 4, 5, -100, 7, 8, 9, 10])
    assert one(budget=100, train_on_prompt=True).labels == list(range(1, 11))
    assert one(budget=100, mask_history=True)[:] == ([1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [-100] * 6 + [7, 8, 9, 10])
    assert one(budget=5).input_ids == [1, 2, 3, 4, 5]
    assert one(budget=6, mask_history=True).input_ids == [1, 6, 7, 8, 9, 10] and one(budget=6).input_ids == [1, 2, 3, 4, 5, 6]


def test_masks_and_placeholders(spark):
    m = [("user", "a b"), ("assistant", "c"), ("user", ""), ("assistant", " d  e ")]
    df = spark.createDataFrame([(m, "x<i>y<i><i>", [2, 0])], "m array<struct<role: string, content: string>>, t string, n array<int>")
    r = df.select(R.token_masks(F.col("m")).alias("a"), R.token_masks(F.col("m"), last_only=True).alias("b"), R.expanded_placeholders(F.col("t"), "<i>", "T", F.col("n")).alias("t")).first()
    assert [tuple(x) for x in r.a] == [("a", False), ("b", False), ("c", True), ("d", True), ("e", True)]
    assert [x.trained for x in r.b] == [False, False, False, True, True] and r.t == "xTTy<i>"


@pytest.mark.parametrize(("text", "want"), [("so it is Paris.", ["paris"]), ("a\nb", ["a\nb"]), ("The result is 3\nx = 4", ["3", "4"]), ("answer !", ["answer !"]), ("x = 1\ny", ["x = 1\ny"])])
def test_open_answers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(R.open_answers(F.col("t")).alias("a")).first().a == want


@pytest.mark.parametrize(("text", "want"), [(None, ""), ("<think>a</think> b ", "b"), ("x \\boxed{a{b}c} d}", "a{b}c"), ("\\boxed{open", "\\boxed{open"), ("<answer>1</answer><answer>2</answer>", "1")])
def test_research_answers(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(R.research_answer(F.col("t")).alias("a")).first().a == want


def test_resized_split_and_blend(spark):
    df = spark.range(20)
    assert B.resized(df, "id", 8).distinct().count() == 8 and B.resized(df, "id", 50).count() == 50 and B.resized(df, "id", 50).select("id").distinct().count() == 20
    assert B.train_val_split(df, "id", 0.25).where("part = 'validation'").count() == 5 and B.train_val_split(df, "id", 3).where("part = 'validation'").count() == 3
    batches = B.mini_batches(df, "id", 8, 2).groupBy("epoch", "batch").count().collect()
    assert sorted(r["count"] for r in batches) == [4, 4, 8, 8, 8, 8]
    rows = spark.createDataFrame([(d, r) for d, n in ((0, 30), (1, 10)) for r in range(n)], "ds int, row long")
    order = [r.ds for r in B.exhaustive_blend(rows, "ds", "row").orderBy("place").collect()]
    assert all(abs(sum(order[:k]) - k / 4) <= 1 for k in range(41))
    with pytest.raises(ValueError):
        B.rename_columns(df, ["id"], [])
