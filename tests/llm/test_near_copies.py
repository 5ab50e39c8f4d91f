"""The n-gram Jaccard join against brute force, at the parameters of its query and of the pipeline."""

from __future__ import annotations

import random

import pytest

from gleanery.llm import ngram_join

WORDS = [f"w{i}" for i in range(60)]


def brute(rows: list[tuple], n: int, percent: int) -> list[tuple]:
    """doc_id, n_shingles and component_id of each row."""
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for _, t in rows:
        w = lower(t).encode().split()  # bytes split at the six ASCII white-space bytes alone
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    named = [i for i, (key, _) in enumerate(rows) if key is not None]
    for i in named:
        for j in named:
            o = len(sets[i] & sets[j])
            if j < i and (rows[i][0] == rows[j][0] or o and 100 * o >= percent * len(sets[i] | sets[j])):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i in named:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted(((k, len(s), least[find(i)] if k is not None else None) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def texts(seed: int) -> list[str]:
    """Families of near copies around the threshold, passages and phrases that many share, and texts of their own."""
    rng = random.Random(seed)
    own = lambda k: [f"u{rng.randrange(10**9)}" for _ in range(k)]
    passage, out = own(45), []
    for _ in range(12):
        base = own(rng.choice([3, 12, 60, 150]))
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage[: rng.choice([10, 45])]
        for _ in range(rng.randint(1, 12)):
            x = base.copy()
            for _ in range(rng.randint(0, 1 + len(x) // 40)):
                x[rng.randrange(len(x))] = rng.choice(WORDS)
            out.append(" ".join(x[rng.choice([0, 0, 1]) :]))
    out += [" ".join(passage + own(rng.randint(1, 30))) for _ in range(25)]
    out += [" ".join(rng.choices(WORDS[:4], k=rng.randint(1, 40))) for _ in range(30)]
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 512), (5, 80, 512), (3, 90, 6), (5, 80, 6), (3, 60, 6), (2, 100, 4)])
def test_groups_are_those_of_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rng = random.Random(n * percent)
    rows = [(i * 3, t) for i, t in enumerate(texts(percent))]
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, None), (4, None), (5, " \t"), (7, "A b"), (8, "a\nB"), (10, "a b"), (11, ""), (9, rows[5][1] + " more")]
    rows += [rows[3], rows[3], (rows[4][0], rows[9][1])]  # a repeated row, and an id on two texts
    docs = spark.createDataFrame([(k, t, 1, "s", 5) for k, t in rows], "doc_id long, text string, sig int, comp string, part int")
    got = ngram_join.jaccard_groups(docs, n, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = brute(rows, n, percent)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 10
