"""Labels and scores of licence scans against plain search and a recursive-descent reading of expressions."""

from __future__ import annotations

import random
import re

from gleanery.llm import licenses as L


def read(expression):
    """(labels, openness) of a well-formed expression, else None: alternatives of conjunctions of licences, some with an exception."""
    tokens = re.findall(r"[()]|[A-Za-z0-9.+_-]+", expression)
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def atom():
        nonlocal at
        if peek() == "(":
            at += 1
            out = either()
            if peek() != ")":
                raise ValueError
            at += 1
        elif peek() is None or peek() in ("and", "or", "with", ")"):
            raise ValueError
        else:
            label = L.family(tokens[at])
            out = {label}, L.OPEN.get(label, L.UNKNOWN)
            at += 1
        while peek() == "with":
            at += 1
            atom()
        return out

    def both():
        nonlocal at
        out = atom()
        while peek() == "and":
            at += 1
            more = atom()
            out = out[0] | more[0], min(out[1], more[1])
        return out

    def either():
        nonlocal at
        out = both()
        while peek() == "or":
            at += 1
            more = both()
            out = out[0] | more[0], max(out[1], more[1])
        return out

    return either()


def expression(rng, depth=3):
    if not depth or rng.random() < 0.3:
        one = rng.choice(["MIT", "Apache-2.0", "GPL-3.0-only", "gpl-2.0+", "CC-BY-NC-4.0", "CC-BY-4.0", "0BSD", "see", "Weird-1.0", "MPL-2.0"])
        return one + rng.choice(["", "", " WITH Classpath-exception-2.0"])
    inner = f" {rng.choice(['AND', 'or', 'OR', 'and'])} ".join(expression(rng, depth - 1) for _ in range(rng.randint(1, 3)))
    return f"({inner})" if rng.random() < 0.7 else inner


def test_labels_and_scores_are_those_of_plain_search():
    rng = random.Random(11)
    phrases = L.BASE | L.NOTICES
    for _ in range(400):
        bits = [rng.choice([*phrases, "cc", "license", "public", "word", "é", "MIT", "general"]) for _ in range(rng.randint(0, 12))]
        told = [expression(rng) for _ in range(rng.choice([0, 0, 1, 2]))]
        text = rng.choice([" ", "\n", ", "]).join(b.upper() if rng.random() < 0.3 else b for b in bits) + "\n" + "".join(f"// SPDX-License-Identifier: {e}\n" for e in told)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        found = {p: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p in phrases}
        labels = {phrases[p] for p, at in found.items() if at}
        opens = [L.OPEN[x] for x in labels]
        for e in told:
            names, value = read(e)
            labels |= names
            opens.append(value)
        got = L.scan(text.encode())
        base = sorted(i for p in L.BASE for i in found[p])
        assert got[:4] == (len(words), len(base), min(base, default=None), max(base, default=None))
        assert got[5] == ",".join(sorted(labels)) and got[6] == min(opens, default=L.NONE_FOUND)


def test_words_after_a_tag_are_no_labels():
    assert L.scan(b"SPDX-License-Identifier: see below")[5:7] == ("other", L.UNKNOWN)
    assert L.scan(b"SPDX-License-Identifier: MIT OR")[5:7] == ("mit", 0.0)
    assert L.scan(b"SPDX-License-Identifier:")[5] == ""
