"""Queries over whole texts, on rows that differ only far from their starts."""

from __future__ import annotations

import collections
import re
import string
import threading

import pytest

from gleanery.plans import catalog

TAIL = "x" * 30 + " " + "word " * 30


def _run(spark, path, name, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
    return catalog.QUERIES[name](spark, str(path)).collect()


def _turn(i, text):
    return (1, i, "user" if i % 2 == 0 else "assistant", text)


TURNS = "conv_id long, turn int, role string, text string"


def _words(text):
    text = "".join(c for c in text.lower() if c not in string.punctuation)
    return re.sub(r"\b(a|an|the)\b", " ", text).split()


def _f1(a, b):
    a, b = _words(a), _words(b)
    same = sum((collections.Counter(a) & collections.Counter(b)).values())
    return 2 * same / (len(a) + len(b)) if same else 0.0


def test_answers_that_differ_late(spark, tmp_path):
    texts = [TAIL + "the end", TAIL + "An end!", TAIL + "end of a different length", "short"]
    got = _run(spark, tmp_path, "txt28_answer_f1", conversations=([_turn(i, t) for i, t in enumerate(texts)], TURNS))
    assert {r.turn: r.em for r in got} == {0: True, 1: False, 2: False}
    assert {r.turn: r.f1 for r in got} == {i: pytest.approx(_f1(texts[i], texts[i + 1]), abs=1e-6) for i in range(3)}


def test_actions_and_answers_beyond_a_prefix(spark, tmp_path):
    texts = [TAIL + "a", TAIL + "b", TAIL + "c", "y" * 3000 + "z"]
    turns = {"conversations": ([_turn(i, t) for i, t in enumerate(texts)], TURNS)}
    got = {r.turn: r for r in _run(spark, tmp_path, "txt25_win19_actions", **turns)}
    assert [got[i].content for i in range(3)] == texts[:3] and [got[i].kind for i in range(4)] == ["tool_call", "final_answer", "final_answer", "reasoning"]
    answers = {r.turn: r.answer for r in _run(spark, tmp_path, "txt26_final_answer", **turns)}
    assert answers == {0: f"<think>{texts[0]}</think><tool_call>{texts[0]}</tool_call>"[-2000:], 1: texts[1], 2: texts[2], 3: "y" * 2000}


def test_prompts_hold_whole_texts(spark, tmp_path):
    turns = {"conversations": ([_turn(0, TAIL + "q")], TURNS)}
    assert [r.prompt for r in _run(spark, tmp_path, "cnv01_instruction_rows", **turns)] == [f"user:{TAIL}q|assistant:ok|user:{TAIL}q"]
    docs = {"documents": ([(1, TAIL + "u", "en", "s"), (2, TAIL + "v", "en", "s")], "doc_id long, text string, lang string, source string")}
    assert [r.prompt for r in _run(spark, tmp_path, "cnv20_few_shot", **docs)] == [f"Q: {TAIL}u\nA: en\nQ: {TAIL}v\nA: en"]
    got = {r.id: r.question for r in _run(spark, tmp_path, "prj19_numbered_rows", **docs)}
    assert got == {0: f"image_1: 1 \n Question: {TAIL}u", 1: f"image_2: 1 \n Question: {TAIL}v"}


def test_whole_addresses_are_compared(spark, tmp_path):
    url = "https://example.org/" + "a" * 40 + "/12"
    got = _run(spark, tmp_path, "evl05_edit_similarity", pages=([(1, url, "<title>t</title>")], "page_id long, url string, html string"))
    assert [r.anls for r in got] == [pytest.approx(1 - 2 / len(url), abs=1e-6)]


def test_answers_of_many_words(spark, tmp_path):
    """Two texts of 30,000 different words, one of a word repeated, one null: in 60 seconds, as time grows with the words."""
    words = [f"w{i}" for i in range(30_000)]
    texts = [" ".join(words), " ".join(reversed(words)) + " w1 w1", "w1 " * 30_000 + "yes", None, "w1 w11 w1.", "W1 w1 w1 w"]
    got = []
    run = threading.Thread(target=lambda: got.extend(_run(spark, tmp_path, "txt28_answer_f1", conversations=([_turn(i, t) for i, t in enumerate(texts)], TURNS))), daemon=True)
    run.start()
    run.join(60)
    assert {r.turn: (r.em, r.f1) for r in got} == {t: (None if texts[t] is None else False, pytest.approx(_f1(texts[t] or "", texts[t + 1]), abs=1e-6)) for t in (0, 1, 3, 4)}
