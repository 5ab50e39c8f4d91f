"""Scores of answers: tags, mathematics, numbers, routed rewards, overlap with references."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import gsm_answer, normalize_answer

ROUTES: dict[str, Callable[[Column, Column], Column]] = {}


def route(*sources: str) -> Callable:
    """Register a scorer of (answer, truth) for data sources; a source that is taken is an error."""

    def keep(fn: Callable) -> Callable:
        for s in sources:
            if ROUTES.setdefault(s, fn) is not fn:
                raise ValueError(f"source {s} has a scorer")
        return fn

    return keep


def routed(source: Column, answer: Column, truth: Column) -> Column:
    """The score by the data source's scorer; an unknown source is an error."""
    out = F.when(F.lit(False), F.lit(0.0))
    for name, fn in ROUTES.items():
        out = out.when(source == name, fn(answer, truth))
    return out.otherwise(F.raise_error(F.concat(F.lit("no scorer for "), source)))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """What is taken off a reward for the part of an answer inside the buffer before ``most``: 0 or less."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def tagged_answer(text: Column) -> Column:
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1)))


def tag_score(text: Column, golds: Column, format_score: float = 0.0, score: float = 1.0, part: bool = False) -> Column:
    """Score of the last answer tag against gold answers (equal, or containing one if ``part``); a quarter if a tag stands more than ten times."""
    a = normalize_answer(tagged_answer(text))
    hit = F.exists(golds, lambda g: a.contains(normalize_answer(g)) if part else normalize_answer(g) == a)
    times = lambda t: (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)
    many = (times("<answer>") > 10) | (times("</answer>") > 10)
    return F.when(tagged_answer(text).isNull(), 0.0).when(hit & many, score / 4).when(hit, score).otherwise(format_score)


@route("gsm8k")
def gsm_score(text: Column, truth: Column) -> Column:
    return F.coalesce(gsm_answer(text) == truth, F.lit(False)).cast("double")


@route("search_qa")
def qa_score(text: Column, truth: Column) -> Column:
    return tag_score(text, F.array(truth))


# ------------------------------------------------------------------ mathematics

# What a form drops.
_UNITS = re.compile(r"\\text\{ .*")
_DROP = ("\n", "\\!", "\\left", "\\right", "^{\\circ}", "^\\circ", "\\$", "\\%")


def math_form(text: str) -> str:
    """A LaTeX answer in one of its equivalent forms: no spacing or units, whole fractions and roots, leading zeros."""
    s = text.replace("\n", "").replace("\\!", "").replace("\\\\", "\\")
    s = re.sub(r"[td]frac", "frac", s)
    for d in _DROP:
        s = s.replace(d, "")
    s = _UNITS.sub("", s)
    s = s.replace(" .", " 0.").replace("{.", "{0.")
    s = "0" + s if s.startswith(".") else s
    head, eq, tail = s.partition("=")
    s = tail if eq and len(head) <= 2 and "=" not in tail else s
    s = re.sub(r"\\sqrt(\w)", r"\\sqrt{\1}", s).replace(" ", "")
    s = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", s)
    s = "\\frac{1}{2}" if s == "0.5" else s
    return re.sub(r"^(-?\d+)/(-?\d+)$", r"\\frac{\1}{\2}", s)


def math_equal() -> Callable:
    """A vectorised function of two columns: whether two answers have the same form."""

    @F.pandas_udf("boolean")
    def equal(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and math_form(x) == math_form(y) for x, y in zip(a, b, strict=True)])

    return equal


def last_boxed(text: str) -> str | None:
    """The last ``\\boxed{...}`` or ``\\fbox{...}`` with balanced braces."""
    start = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if start < 0:
        return None
    depth = 0
    for i in range(text.index("{", start), len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if not depth:
            return text[start : i + 1]
    return None


def countdown(equation: str, numbers: list[int], target: int) -> float:
    """1 if the equation uses each number once and gives the target, 0.1 if it is an equation at all, else 0."""
    if not re.fullmatch(r"[\d+\-*/(). ]+", equation or ""):
        return 0.0
    if sorted(map(int, re.findall(r"\d+", equation))) != sorted(numbers):
        return 0.1
    value = _evaluate(equation)
    return 1.0 if value is not None and abs(value - target) < 1e-5 else 0.1


def _evaluate(expression: str) -> float | None:
    """Value of +, -, *, / and brackets by recursive descent; None if malformed."""
    tokens = re.findall(r"\d+\.?\d*|[-+*/()]", expression)
    at = 0

    def atom() -> float:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "(":
            v = total()
            if tokens[at] != ")":
                raise ValueError
            at += 1
            return v
        return -atom() if t == "-" else float(t)

    def product() -> float:
        nonlocal at
        v = atom()
        while at < len(tokens) and tokens[at] in "*/":
            times = tokens[at] == "*"
            at += 1
            other = atom()
            v = v * other if times else v / other
        return v

    def total() -> float:
        nonlocal at
        v = product()
        while at < len(tokens) and tokens[at] in "+-":
            sign = 1 if tokens[at] == "+" else -1
            at += 1
            v += sign * product()
        return v

    try:
        v = total()
        return v if at == len(tokens) else None
    except (ValueError, IndexError, ZeroDivisionError):
        return None


# ------------------------------------------------------------------ overlap with references


def _f(match: float, a: int, b: int) -> float:
    return 0.0 if not match else 2 * match / (a + b)


def overlap(answer: str, reference: str) -> tuple[float, float, float, float]:
    """Character BLEU-4 (smoothed) and ROUGE-1, 2, L of characters, in per cent with 4 decimals."""
    a, r = list(answer), list(reference)
    logs, rouge = [], []
    for n in range(1, 5):
        ga, gr = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, r))
        same = sum((ga & gr).values())
        logs.append(math.log((same or 0.1) / max(sum(ga.values()), 1)))
        if n < 3:
            rouge.append(_f(same, sum(ga.values()), sum(gr.values())))
    brevity = 1.0 if len(a) >= len(r) else math.exp(1 - len(r) / max(len(a), 1))
    row = [0] * (len(r) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(r):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    bleu = 0.0 if not a or not r else brevity * math.exp(sum(logs) / 4)
    return tuple(round(100 * x, 4) for x in (bleu, *rouge, _f(row[-1], len(a), len(r))))


def overlap_scores() -> Callable:
    @F.pandas_udf("struct<bleu4: double, rouge1: double, rouge2: double, rougel: double>")
    def scores(a: pd.Series, r: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([overlap(x or "", y or "") for x, y in zip(a, r, strict=True)], columns=["bleu4", "rouge1", "rouge2", "rougel"])

    return scores
