"""Logs of deltas, edits and regenerations against a fold by hand, event by event."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from gleanery.llm import chat_format, queries


def folded(log):
    turns: dict = {}
    for _, seq, turn, event, role, text in sorted(log, key=lambda e: (e[1], e[4], e[5])):
        if event == "regenerate":
            for t in [t for t in turns if t > turn]:
                del turns[t]
        m = turns.setdefault(turn, [])
        if event in ("edit", "regenerate"):
            turns[turn] = [(role, text)]
        elif event == "delta" and m:
            m[-1] = (m[-1][0], m[-1][1] + text)
        else:
            m.append((role, text))
    return [m for t in sorted(turns) for m in turns[t]]


def test_folds_are_those_of_a_replay(spark):
    rng = random.Random(3)
    logs = [(c, i, rng.randint(0, 9) * 30, rng.choice(["message", "delta", "delta", "edit", "regenerate"]), rng.choice(["user", "assistant"]), rng.choice(["a<", "\\b", "c>", ""])) for c in range(40) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame([(*e, "x", 1) for e in logs], "conv_id long, seq long, turn long, event string, role string, text string, block string, cut int")
    out = chat_format.format_chats(df).select("conv_id", chat_format.parse(F.col("formatted")).alias("m"), chat_format.masked_text(F.col("blocks")).alias("loss"))
    for r in out.collect():
        want = folded([e for e in logs if e[0] == r.conv_id])
        assert [tuple(m) for m in r.m] == want and r.loss == "".join(t for role, t in want if role == "assistant")


def test_a_table_is_the_fold_of_its_log(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}" * t) for t in range(200)] + [(1, 7, "assistant", "again"), (2, 0, None, None), (2, None, "user", "x"), (None, 5, "user", "y"), (3, 1, "assistant", "z"), (3, 1, "assistant", "z"), (4, 2, "user", "odd length")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = queries.chat_log(df)
    assert {"delta", "edit", "regenerate"} <= {r.event for r in log.collect()} and log.count() > 2 * len(rows)
    out = chat_format.format_chats(log).select("conv_id", chat_format.parse(F.col("formatted")).alias("m"))
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in out.collect():
        assert [tuple(m) for m in r.m] == [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == r.conv_id), key=order)]


def test_many_deltas_of_one_turn(spark):
    log = spark.range(20000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("turn"), F.when(F.col("id") == 0, "message").otherwise("delta").alias("event"), F.lit("assistant").alias("role"), F.lit("ab").alias("text"))
    assert chat_format.masked_text(F.col("blocks")) is not None
    r = chat_format.format_chats(log).select(F.length(chat_format.masked_text(F.col("blocks"))).alias("n"), "n_turns").first()
    assert (r.n, r.n_turns) == (40000, 1)
