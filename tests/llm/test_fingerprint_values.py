"""Order MinHash against a plain reading of its definition, and neighbours over many ranges."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from gleanery.llm import common as C
from gleanery.llm import order_minhash as O


def plain(text: str, m: int, l: int, k: int) -> list[int]:  # noqa: E741
    """The sketches of a text by loops over its k-mers, with the module's own hash of a unit and mixers."""
    data, offsets = O._bytes_of([text])
    units = O.units(data, offsets)[0].tolist()
    one = lambda x: int(C.mix(np.array([x % 2**64], np.uint64))[0])
    grams = [units[i : i + k] for i in range(max(1, len(units) - k + 1))] if units else []
    seen: dict = {}
    numbered = []
    for g in grams:
        h = 0x2545F4914F6CDD1D
        for u in g:
            h = one(h * 0x9E3779B97F4A7C15 + u)
        n = seen[h] = seen.get(h, -1) + 1
        numbered.append(one(h + one(n)))
    out = []
    for j in range(m):
        keys = []
        for i, x in enumerate(numbered):
            key = (x * int(O._MULTIPLIERS[j]) + int(O._SHIFTS[j])) % 2**64
            key ^= key >> 31
            keys.append((key * 0x9FB21C651E98DF25 % 2**64 >> O.PLACE_BITS, i))
        chosen = sorted(i for _, i in sorted(keys)[:l])
        h = 0x9E3779B97F4A7C15
        for i in chosen:
            h = one(h * 31 + numbered[i])
        out.append(h >> 32 if chosen else O.EMPTY)
    return out


def test_sketches_are_those_of_the_definition():
    rng = random.Random(2)
    texts = ["", " ", "a", "a b", "a b a b a b", "日本語のテキストです長い", *(" ".join(rng.choices("abcdef", k=rng.randint(1, 40))) for _ in range(30))]
    for l, k in ((2, 2), (3, 1), (5, 3)):  # noqa: E741
        got = O.sketches(*O._bytes_of(texts), m=6, l=l, k=k)
        assert got.tolist() == [plain(t, 6, l, k) for t in texts]


def test_neighbours_over_ranges(spark):
    rng = random.Random(9)
    rows = [(i * 7, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(200)] + [(None, "null id"), (None, "another"), (21, "an id on two rows"), (5, None), (6, "x" * 40000)]
    docs = spark.createDataFrame([(k, t, 1, True) for k, t in rows], "doc_id long, text string, range int, tail boolean")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in O.fingerprints(docs).collect())
    texts = [(k is not None, k or 0, t or "") for k, t in rows]
    order = sorted(texts)
    want = []
    for (there, key, t), (_, _, nxt) in zip(order, order[1:] + order[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        s = O.sketches(*O._bytes_of([t, edited, nxt]))
        want.append((there, key, len(t), hashlib.sha256(edited.encode()).hexdigest(), O.likeness(s[:1], s[1:2])[0], O.likeness(s[:1], s[2:])[0]))
    assert got == sorted(want)
