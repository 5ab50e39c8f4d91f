"""Golden values and laws of the library's operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.functions import arrays as A
from gleanery.functions import text as T
from gleanery.operators import advantages as V
from gleanery.operators import conversations as C
from gleanery.operators import datasets as D
from gleanery.operators import evaluation as E
from gleanery.operators import graph as G
from gleanery.operators import similarity as S
from gleanery.operators import stores as K


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_group_stats(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (3.0, 0)], "score double, gid int")
    got = {(r.gid): (r.g_mean, r.g_std, r.g_n) for r in V.group_stats(df, ["gid"], "score").collect()}
    assert got[0][0] == 2 and got[0][1] == pytest.approx(2**0.5) and got[0][2] == 2
    assert got[1] == (0, 1, 1)


def test_single_rows(spark):
    df = spark.createDataFrame([(1, 3.0)], "g int, s double")
    assert V.advantage(df, "rloo", ["g"], "s").first().advantage == 3
    assert V.advantage(df, "rloo_vectorised", ["g"], "s").first().advantage == 0
    assert V.advantage(df, "grpo", ["g"], "s").first().advantage == pytest.approx(3, rel=1e-5)


def test_estimator_names_are_unique():
    with pytest.raises(ValueError):
        V.estimator("grpo")(lambda: None)


@pytest.mark.parametrize(("errors", "end", "want"), [([0, 1, 1, 1, 0], "answer", 1), ([1, 1, 0, 1, 1], "answer", None), ([1, 1, 0, 1, 1], "timeout", 5)])
def test_fatal_step(spark, errors, end, want):
    df = spark.createDataFrame([("e", i, bool(x), end) for i, x in enumerate(errors)], "ep string, i int, err boolean, fin string")
    assert V.fatal_step(df, ["ep"], "i", F.col("err"), "fin").first().fatal_step == want


@pytest.mark.parametrize(("s", "t", "want"), [(3000, 2000, (600, 400)), (2000, 3000, (400, 600)), (1000, 100, (900, 100)), (100, 1000, (100, 900)), (100, 500, (100, 500)), (500, 100, (500, 100)), (10, 10, (10, 10))])
def test_length_budget(spark, s, t, want):
    assert tuple(one(spark, A.length_budget(F.lit(s), F.lit(t), F.lit(1000))).c0) == want


def test_gae_and_returns(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, A.discounted_returns(arr(1.0, 2.0, 3.0), arr(1, 1, 1), 0.5), A.gae(arr(0.0, 1.0), arr(0.5, 0.5), arr(1, 1), 1.0, 1.0), A.masked_sum(arr(1.0, float("nan")), arr(1, 0)))
    assert r.c0 == [2.75, 3.5, 3.0] and r.c1 == [0.5, 0.5] and r.c2 == 1


def test_answers(spark):
    arr = lambda *x: F.array(*map(F.lit, x))
    r = one(spark, T.exact_match(F.lit("The Eiffel Tower."), F.lit("eiffel tower")), T.token_f1(F.lit("yes"), F.lit("no")), T.anls(F.lit("hello"), arr("hallo")), T.relaxed_match(F.lit("10.4"), F.lit("10")), T.relaxed_match(F.lit("-10"), F.lit("-10")), T.relaxed_match(F.lit("-10"), F.lit("-10"), strict=True))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4, r.c5) == (True, 0, pytest.approx(0.8), 1, 0, 1)


def test_final_answer(spark):
    r = one(spark, T.final_answer(F.lit("x \\boxed{a {b} \\text{c}} y")), T.final_answer(F.lit("<answer> q </answer>")), T.final_answer(F.lit("t</think> z <tool_call>x</tool_call>")), T.gsm_answer(F.lit("a #### 1,000\n#### 7")), T.verdict(F.lit("Correct: Yes")))
    assert (r.c0, r.c1, r.c2, r.c3, r.c4) == ("a {b} c", "q", "z", "7", 1)


def test_html_order(spark):
    r = one(spark, T.clean_html(F.lit('<img src="data:image/png;base64,AA" alt="x">')), T.images_to_alt(F.lit('a<img alt="x">b')), T.entity_label(F.lit("F.C. Barcelona!")))
    assert (r.c0, r.c1, r.c2) == ("", "a x b", "f c barcelona")


def test_stable_id(spark):
    import hashlib

    assert one(spark, T.stable_id("text", F.lit("a"), F.lit(None), F.lit("b"))).c0 == "text_" + hashlib.sha256(b"a||||b").hexdigest()[:16]


def test_turns(spark):
    m = F.array(*(C.message(r, F.lit(t)) for r, t in (("system", "s"), ("user", "u"), ("assistant", "a"))))
    r = one(spark, C.from_turns(m), C.from_turns(F.slice(m, 1, 2)))
    assert [x.content for x in r.c0._prompt] == ["u"] and [x.content for x in r.c0._response] == ["a"] and r.c0._system == "s"
    assert r.c1._prompt == [] and r.c1._response == []


def test_action_calls(spark):
    r = one(spark, C.action_calls(F.lit('Action: test_tool\nAction Input: {"foo": "bar", "size": 10}')))
    assert [tuple(x) for x in r.c0] == [("test_tool", '{"foo": "bar", "size": 10}')]


def test_packing():
    assert D.knapsack([2, 3, 5, 7], 10) == [[7, 3], [5, 2]]
    with pytest.raises(ValueError):
        D.knapsack([11], 10)
    parts = D.balanced_partitions([5, 1, 4, 2, 3, 3], 3, equal_size=True)
    assert sorted(i for p in parts for i in p) == list(range(6)) and all(len(p) == 2 for p in parts)
    assert D.lightest_bin([3, 1, 1], 2) == [[0], [1, 2]]


def test_blends():
    assert [k for k, _ in D.blend_index([0.5, 0.5], 4)] == [0, 1, 0, 1]
    assert sorted(D.exhaustive_blend_index([2, 1])) == [(0, 0), (0, 1), (1, 0)]
    assert D.split_bounds([0.99, 0.01, 0]) == [(0.0, 0.99), (0.99, 1.0), None]
    assert D.partition_bounds(10, 3) == [(0, 3), (3, 6), (6, 10)]


def test_positions_and_chunks(spark):
    df = spark.range(100).select((99 - F.col("id")).alias("k"))
    assert all(r.pos == r.k for r in D.with_position(df, ["k"], n_ranges=7).collect())
    c = D.chunks(spark.createDataFrame([(1, 10)], "d int, n int"), "n", 4).collect()
    assert sorted((r.begin, r.stop) for r in c) == [(0, 4), (4, 8), (8, 10)]


def test_majority(spark):
    rows = spark.createDataFrame([(0, "A", 0.9, 0), (0, "B", 0.8, 1), (0, "A", 0.7, 2)], "g int, v string, x double, p int")
    r = E.majority(rows, ["g"], "v", "x", "p").first()
    assert (r.majority, r.value, r.votes) == ("A", 0.9, 2)


def test_timing_median(spark):
    rows = spark.createDataFrame([("k", float(x)) for x in (4, 1, 3, 2)], "key string, v double")
    assert E.timing_summary(rows, "key", "v").first().p50 == 3


def test_upsert_keeps_created_at(spark):
    old = spark.sql("select 1L as id, 'a' as data, timestamp '2020-01-01' as created_at, timestamp '2020-01-01' as updated_at")
    new = spark.sql("select 1L as id, 'b' as data union all select 2L, 'c'")
    got = {r.id: (r.data, r.created_at.year, r.updated_at.year) for r in K.store_traces(old, new, F.expr("timestamp '2030-01-01'")).collect()}
    assert got == {1: ("b", 2020, 2030), 2: ("c", 2030, 2030)}


def test_graph(spark):
    nodes = spark.range(6).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(0, 1), (2, 1), (3, 4)], "src long, dst long")
    assert {r.node: r.component for r in G.connected(nodes, edges).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert {r.node: r.level for r in G.levels(edges, spark.range(1).select(F.col("id").alias("node"))).collect()} == {0: 0, 1: 1, 2: 2}


def test_entity_linking(spark):
    nodes = spark.createDataFrame([(1, ["FC Barcelona"]), (2, ["Real Madrid", "Real"]), (3, ["Madrid"])], "node int, names array<string>")
    labels = spark.createDataFrame([("f.c. barcelona",), ("fc barcelona",), ("barcelona",), ("real",), ("madrid",), ("paris",)], "label string")
    got = {r.label: r.node_match for r in G.link_labels(labels, nodes).collect()}
    assert got == {"f.c. barcelona": None, "fc barcelona": 1, "barcelona": 1, "real": 2, "madrid": 3, "paris": None}


def test_nearest(spark):
    e = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
    got = {r.query_id: r.neighbours for r in S.nearest(e, e, 2, pad=True).collect()}
    assert got[0] == [1, 2] and got[3] == [2, 4]
    assert {r.query_id: r.neighbour_id for r in S.nearest(e, e, 1, group="label").collect()}[0] == 1
