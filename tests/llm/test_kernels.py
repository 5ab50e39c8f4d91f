"""Byte kernels and the operators' in-task parts against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import common as C
from gleanery.llm import hamming_topk, licenses, ngram_join, order_minhash, quality_fm, sharding, token_files
from gleanery.llm.sentencepiece_codec import codec

TEXTS = ["", " ", "a", "a b", "Ab\tcd  é x", "x" * 5000, "the the the the", None, "日本語 テキスト", "a\n\nb c d e f g"]


def test_spans_are_words():
    data, offsets = C.flat(pa.array(TEXTS))
    starts, ends, rows = C.spans(data, offsets)
    got = [(r, bytes(data[s:e])) for s, e, r in zip(starts, ends, rows, strict=True)]
    assert got == [(i, w) for i, t in enumerate(TEXTS) for w in (t or "").encode().split()]
    hashes = C.span_hashes(data, starts, ends)
    assert len({w for _, w in got}) == len(set(hashes.tolist()))


def test_texts_that_touch_are_parted():
    data, offsets = C.flat(pa.array(["ab", "ab", "", "abab"]))
    starts, ends, rows = C.spans(data, offsets)
    assert rows.tolist() == [0, 1, 3]
    h = C.span_hashes(data, starts, ends)
    assert h[0] == h[1] != h[2]


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


def _random_texts(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    out = ["".join(rng.choice(" ab\n▁éthe<>0x0A😀ſ中国人語ing  ́\x00") for _ in range(rng.randint(0, 50))) for _ in range(n)]
    return out + [rng.choice(["ab", "na", "aa", "   ", "ing"]) * rng.randint(1, 30) + rng.choice(["", "x"]) for _ in range(n // 2)]


def test_sentencepiece_is_the_library(public):
    import sentencepiece

    path = public.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), codec(path)
    texts = ["", " ", "  a  ", *_random_texts(400, 1)]
    ids, at = c.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode(texts)
    assert c.decode(ids, at) == [sp.decode(sp.encode(t)) for t in texts]
    rng = random.Random(2)
    rows = [[rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 29871]) for _ in range(rng.randint(0, 20))] for _ in range(500)]
    flat = np.array([x for r in rows for x in r], np.int32)
    assert c.decode(flat, np.concatenate([[0], np.cumsum([len(r) for r in rows])])) == [sp.decode(r) for r in rows]


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    for top in (1, 2, 100, 50_000, 2**31):
        sizes = rng.integers(1, 600, 20)
        ids = rng.integers(0, top, sizes.sum())
        ids[rng.random(len(ids)) < 0.03] = 2**31 - 1
        lists = token_files.pack(ids, sizes) | {"ids": np.arange(20), "known": np.ones(20), "sizes": sizes}
        back = token_files.from_segment(token_files.to_segment(lists))
        assert (token_files.unpack(back, back["sizes"]) == ids).all()


def test_word_tokenizer_is_the_library(public):
    from tokenizers import Tokenizer

    t = token_files.tokenizer("word_bpe_49k.json")
    ref = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    for texts in (_random_texts(200, 3), ["<|endoftext|> a<|startoftext|>b", "ΑΣ Σ it's 12"], ["It's (he)'ll...x,y;Z!'s a''re <|ENDOFTEXT|> b", "e\u0301. <\u0338 o\u0338a<\u0338 'tis a'", "a", ".", "b."], ["Word, WORD. word's", "é,ñ.x", "x-ray_y 3.14 a1b2"]):
        ids, sizes = t.encode(*C.flat(pa.array(texts)), 1)
        at = np.concatenate([[0], np.cumsum(sizes)])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*ref.encode(x, add_special_tokens=False).ids, 1] for x in texts]


def test_span_cache_is_its_encoder():
    told = []

    def encode(words):
        told.extend(words)
        got = [list(w) for w in words]
        return np.array([x for g in got for x in g], np.int32), np.concatenate([[0], np.cumsum([len(g) for g in got])]).astype(np.int64)

    rng = random.Random(4)
    cache = C.SpanCache(encode, limit=50)
    for _ in range(20):
        words = ["".join(rng.choices("abc", k=rng.choice([1, 2, 3, 4, 90]))) for _ in range(80)]
        data, offsets = C.flat(pa.array([" ".join(words)]))
        starts, ends, _ = C.spans(data, offsets)
        places = cache.lookup(data, starts, ends)
        ids, at = C.gather(cache.ids, cache.offsets, places)
        assert [bytes(ids[a:b].astype(np.uint8)).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == words
    assert cache.held == 50 and len(told) > 200


def test_tokenizers_that_look_across_spaces_get_whole_texts(public):
    import json
    from pathlib import Path

    spec = json.loads(Path(public.path("word_bpe_49k.json")).read_text())
    assert token_files.parts_at_spaces(spec)
    assert not token_files.parts_at_spaces(spec | {"pre_tokenizer": None})
    assert not token_files.parts_at_spaces(spec | {"normalizer": {"type": "Prepend", "prepend": "x"}})
    assert not token_files.parts_at_spaces(json.loads(Path(public.path("byte_bpe_50k.json")).read_text()))
    from tokenizers import Tokenizer

    t, ref = token_files.tokenizer("byte_bpe_50k.json"), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a  b", "", " it's\n\n12 ", "日本 語"]
    ids, sizes = t.encode(*C.flat(pa.array(texts)), 1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [[*ref.encode(x, add_special_tokens=False).ids, 1] for x in texts]


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_linked_sets_share_enough_of_their_prefixes(percent):
    rng = np.random.default_rng(percent)
    for size in (1, 2, 3, 9, 10, 25, 80, 400):
        a = rng.integers(0, 1 << 62, size).astype(np.uint64)
        for change in range(0, max(1, size // 3)):
            for more in (0, 1, size // 8, size // 4):
                b = np.concatenate([a, rng.integers(0, 1 << 62, more).astype(np.uint64)])
                b[:change] = rng.integers(0, 1 << 62, change)
                both = len(np.intersect1d(a, b))
                if set(a) == set(b):  # one class, made before prefixes are
                    continue
                if not both or 100 * both < percent * (len(np.unique(a)) + len(np.unique(b)) - both):
                    continue
                emits, need = ngram_join.prefixes(np.array([size, size + more]), percent)
                shared = len(np.intersect1d(np.sort(a)[: emits[0]], np.sort(b)[: emits[1]]))
                assert shared >= need.max()


def test_tree_finds_all_links():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, (6, 60)).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[i % 6][rng.random(60) < 0.97], rng.integers(0, 1 << 62, 2).astype(np.uint64)])) for i in range(120)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    union = ngram_join._Union(len(sets))
    ngram_join.SignatureTree(np.concatenate(sets), at).links(85, union)
    want = ngram_join._Union(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            o = len(np.intersect1d(sets[i], sets[j]))
            if 100 * o >= 85 * (len(sets[i]) + len(sets[j]) - o):
                want.join(np.array([i]), np.array([j]))
    assert (union.roots() == want.roots()).all()


def test_sketches():
    texts = ["a b c d e f g h", "a b c d e f g h", "h g f e d c b a", "", "  ", "a", "x y z u v w q p"]
    s = order_minhash.sketches(*order_minhash._bytes_of(texts))
    like = lambda i, j: order_minhash.likeness(s[i : i + 1], s[j : j + 1])[0]
    assert like(0, 1) == 1 and like(3, 4) == 1 and like(0, 2) == 0 and like(0, 6) == 0
    long = " ".join(map(str, range(400)))
    t = order_minhash.sketches(*order_minhash._bytes_of([long, long.replace(" 200 ", " x "), " ".join(map(str, range(399, -1, -1)))]))
    assert order_minhash.likeness(t[:1], t[1:2])[0] > 0.9 and order_minhash.likeness(t[:1], t[2:])[0] < 0.1


def test_units_cover_long_runs():
    texts = ["one " + "x" * 16 + " y" * 3, "abcdefghijklmnopq", "é" * 9 + "ab", "日本語テキスト文a 短い", "", "𝒳" * 40]
    got = []
    for t in texts:
        want = []
        for w in t.split():
            raw, at = w.encode(), [len(w[:i].encode()) for i in range(len(w))]
            for i, a in enumerate(at):
                if i and (len(raw) <= 16 or at[i - 1] + 16 >= len(raw)):
                    break
                want.append(raw[a : a + 16] if len(raw) > 16 else raw)
        got.append(want)
    data, offsets = order_minhash._bytes_of(texts)
    hashes, at = order_minhash.units(data, offsets)
    spans = [u for want in got for u in want]
    flat = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(u) for u in spans])
    assert np.diff(at).tolist() == [len(want) for want in got]
    assert (hashes == C.span_hashes(flat, ends - [len(u) for u in spans], ends)).all()


@pytest.mark.parametrize("letters", ["".join(map(chr, range(0x4E00, 0x5200))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdef\u00a0"])
def test_one_edit_in_text_without_spaces(letters):
    r = random.Random(5)
    text = "".join(r.choice(letters) for _ in range(2000))
    texts = [text, letters[0] + text, text[1:], text[:1000] + letters[1] + text[1000:], text[1000:] + text[:1000]]
    s = order_minhash.sketches(*order_minhash._bytes_of(texts))
    for i in (1, 2, 3):
        assert order_minhash.likeness(s[:1], s[i : i + 1])[0] > 0.9
    assert order_minhash.likeness(s[:1], s[4:])[0] < 0.9


def test_sketches_of_texts_beyond_place_bits(monkeypatch):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 5, 300, 40)]
    want = order_minhash.sketches(*order_minhash._bytes_of(texts))
    monkeypatch.setattr(order_minhash, "PLACE_BITS", 5)
    assert (order_minhash.sketches(*order_minhash._bytes_of(texts)) == want).all()


def test_license_words_and_expressions():
    rng = random.Random(4)
    bits = ["cc", "BY", "general", "Public", "license", "all", "rights", "reserved", "é", "x9", "nc"]
    for _ in range(300):
        text = "".join(rng.choice(bits) + rng.choice([" ", "-", "\n", ". "]) for _ in range(rng.randint(0, 25)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = licenses.scan(text.encode())
        starts = [i for i, _ in places]
        assert got[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
    assert licenses.postfix("MIT AND (Apache-2.0 OR GPL-2.0 WITH x)") == ["MIT", "Apache-2.0", "GPL-2.0", "x", "with", "or", "and"]
    assert licenses.evaluate("MIT OR GPL-3.0") == ({"mit", "gpl"}, 0.9) and licenses.evaluate("MIT AND GPL-3.0")[1] == 0.5
    assert licenses.postfix("MIT OR") is None and licenses.postfix("(MIT") is None
    assert "apache" in licenses.scan(b"// SPDX-License-Identifier: Apache-2.0\ncode")[5]


def test_matrix_has_its_margins():
    m = np.array(sharding.communication_matrix([100, 0, 57, 43], [67, 67, 66], 3))
    assert m.sum(1).tolist() == [100, 0, 57, 43] and m.sum(0).tolist() == [67, 67, 66]
    rng = np.random.Generator(np.random.PCG64(1))
    got = [sharding.hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(got) - 6) < 0.12 and abs(np.var(got) - 20 * 0.3 * 0.7 * 80 / 99) < 0.35
    big = sharding.hypergeometric(rng, 10**11, 3 * 10**11, 10**10)
    assert abs(big - 2.5 * 10**9) < 10 * 43_000


def test_factorisation_machine_is_the_double_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine(4, 0.3, rng.normal(size=40), rng.normal(size=(40, 3)))
    slots, values = np.array([1, 5, 9, 2]), np.array([0.5, 1.0, -2.0, 3.0])
    raw, _ = m.raw(slots, values, np.array([0, 4]))
    want = 0.3 + m.linear[slots] @ values + sum(m.factors[slots[i]] @ m.factors[slots[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert raw[0] == pytest.approx(want)


def test_masks():
    assert len(hamming_topk._masks(8, 3)) == 56 and hamming_topk._segments(64, 4) == [(0, 16), (16, 16), (32, 16), (48, 16)]
    assert sum(w for _, w in hamming_topk._segments(50, 3)) == 50
