"""Licence scans: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates licence expressions.

A text is lower-cased (A-Z) and becomes its words, joined by single spaces. One
automaton over the base phrases, the notice phrases and the words of the
identifier tag finds every place, overlapping ones included, in one pass. Where
the tag stands, the rest of its line in the raw text is read as an expression
of identifiers with ``AND``, ``OR``, ``WITH`` and brackets: a shunting-yard
parser turns it into postfix order (WITH binds tightest, then AND, then OR) and
the evaluation gives the identifiers and how open the whole is: AND takes the
least, OR the greatest, WITH that of its licence. Malformed expressions give
the identifiers that stand in them, with openness 0.

Labels are those of all phrases and expressions; identifiers of no known family,
and words that stand for one, have the label ``other``. The score is how free a reader
is to reuse the text: the least openness of all findings (an expression counts
as one), 0 with "all rights reserved"; 0.5 without any finding.

Defined results: null and empty texts have no words, no places, empty labels
and score 0.5; repeated rows give repeated results; an empty table gives no
rows. Other columns are ignored, whatever their names. Texts are scanned whole,
in memory of a small multiple of their own length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import common as C

#: Phrases that the scan's contract names, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices beyond them.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0": "cc0",
    "creative commons": "cc",
    "public domain": "public-domain",
    "boost software license": "bsl",
    "confidential and proprietary": "proprietary",
}
TAG = "spdx license identifier"
#: How free a licence leaves its reader; unknown identifiers count as UNKNOWN.
_BY_OPENNESS = {
    1.0: "public-domain cc0 unlicense 0bsd wtfpl mit-0",
    0.9: "mit bsd isc bsl apache afl artistic blueoak bzip2 curl ecl ftl hpnd icu ijg intel libpng libtiff mulanpsl ms-pl ncsa naist openssl php postgresql psf python ruby tcl unicode upl vim w3c x11 zlib zpl",
    0.8: "cc-by odc-by ofl",
    0.6: "cc mpl epl lgpl cc-by-sa apsl cddl cecill cpl eupl gfdl ipl lppl ms-rl nposl odbl osl qpl spl",
    0.5: "gpl",
    0.4: "agpl sspl rpl",
    0.3: "cc-by-nd cc-by-nc busl elastic polyform",
    0.0: "proprietary reserved",
}
OPEN = {name: value for value, names in _BY_OPENNESS.items() for name in names.split()}
#: The label of identifiers that belong to no family above.
OTHER = "other"
UNKNOWN, NONE_FOUND = 0.2, 0.5
_PREFIXES = sorted(OPEN, key=len, reverse=True)

#: Every byte outside 0-9, a-z, A-Z and non-ASCII is a space; A-Z become a-z.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_TAG_LINE = re.compile(r"spdx[^0-9A-Za-z\n]*license[^0-9A-Za-z\n]*identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+_-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str:
    """The label of a licence identifier: that of the longest known family it begins with, or OTHER."""
    low = identifier.lower()
    return next((p for p in _PREFIXES if low == p or low.startswith((p + "-", p + "+"))), OTHER)


def postfix(expression: str) -> list[str] | None:
    """The shunting-yard order of an expression, None if it is malformed. Text after a complete expression is not part of it."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand must come next
    depth = 0
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _RANK:
            if operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break
            stack.append(token)
            depth += 1
        elif token == ")":
            if operand or not depth:
                return None if operand else _close(out, stack)
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        else:
            if not operand:
                if depth:
                    return None
                break
            out.append(token)
            operand = False
    return None if operand or depth else _close(out, stack)


def _close(out: list[str], stack: list[str]) -> list[str]:
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels of an expression and its openness."""
    order = postfix(expression)
    if order is None:
        names = {family(t) for t in _TOKEN.findall(expression) if t not in "()" and t.lower() not in _RANK}
        return names - {OTHER}, 0.0
    held: list[tuple[set[str], float]] = []
    for token in order:
        if token in _RANK:
            (b, y), (a, x) = held.pop(), held.pop()
            # an exception is no licence of its own
            held.append((a, x) if token == "with" else (a | b, max(x, y) if token == "or" else min(x, y)))
        else:
            label = family(token)
            held.append(({label}, OPEN.get(label, UNKNOWN)))
    return held[0]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found: dict[str, list] = {}
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            key = f" {phrase} ".encode().decode("latin-1")
            found.setdefault(key, []).append((kind, label))
    a = ahocorasick.Automaton()
    for key, what in found.items():
        a.add_word(key, (len(key), what))
    a.make_automaton()
    return a


def scan(text: bytes) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score and spans (start word, label) of one UTF-8 text."""
    words = text.translate(_FOLD).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")  # a byte a character
    places, base, labels, opens, tagged, spans = [], set(), set(), [], False, []
    at, word = 0, 0
    for end, (length, what) in automaton().iter(joined):
        start = end - length + 1
        begin = word + joined.count(" ", at, start) if start >= at else joined.count(" ", 0, start)
        at, word = start, begin
        for kind, label in what:
            if kind == "tag":
                tagged = True
                continue
            if kind == "base":
                places.append(begin)
                base.add(label)
            labels.add(label)
            opens.append(OPEN[label])
            spans.append((begin, label))
    if tagged:
        for m in _TAG_LINE.finditer(text.decode("utf-8", "replace")):
            got, value = evaluate(m[1])
            labels |= got
            opens.append(value)
    score = min(opens) if opens else NONE_FOUND
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(spans)


FIELDS = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())])))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, "text"):
            rows = [scan(x or b"") for x in C.column(part, "text").cast(pa.binary()).to_pylist()]
            cols = [*zip(*rows, strict=True)]
            cols[-1] = [[{"word": w, "label": label} for w, label in x] for x in cols[-1]]
            yield pa.RecordBatch.from_arrays([C.column(part, "doc_id"), *(pa.array(c, kind) for c, (_, kind) in zip(cols, FIELDS, strict=True))], ["doc_id", *(name for name, _ in FIELDS)])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (place and label of each phrase) of each row."""
    C.importable(docs.sparkSession)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<word: long, label: string>>"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(_scan, schema)
