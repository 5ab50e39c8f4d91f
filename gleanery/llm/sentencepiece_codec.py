"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A model's pieces give two tables: the id of each symbol, and for each pair of
symbols whose concatenation is a piece, that piece and its rank. The words of a
batch (runs that start at a white-space mark after another symbol; no piece
reaches over such a place) become one flat symbol array. A round finds each
word's lowest pair rank by a segmented minimum, merges all leftmost pairs of
that rank at once, and compacts the array; rounds go on until no pair remains.
Merging equal pairs at once is the one-by-one order unless a merge opens a pair
of lower rank, which a round notices; those words are run again, one merge to a
round. Symbols that no piece names fall back to the pieces of their bytes.

Decoding gathers the bytes of all pieces and turns runs of byte pieces into
text, one replacement character for each byte that isn't valid UTF-8.

Defined results: null and empty texts have no ids and decode to the empty
text; repeated rows give repeated results; an empty table gives no rows;
columns other than the id and the text are ignored, whatever their names.
Long texts cost memory in proportion to their own length.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import common as C

SPACE = "▁"
NONE = np.iinfo(np.int64).max


def _one_each(e: UnicodeError):
    if not isinstance(e, UnicodeDecodeError):
        raise e
    return "�", e.start + 1


codecs.register_error("gleanery_one_each", _one_each)


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces need resegmentation, which isn't built")
        self.control = np.array([sp.is_control(i) for i in range(n)])
        is_byte = np.array([sp.is_byte(i) for i in range(n)])
        normal = ~(self.control | is_byte)
        normal[sp.unk_id()] = False
        self.unk, self.size = sp.unk_id(), n
        probe = "a  b ﬁ　Å "
        self.normalize = None if sp.normalize(probe) == SPACE + probe.replace(" ", SPACE) else sp.normalize
        self.fallback = bool(is_byte.any())
        self.byte_ids = np.full(256, self.unk, np.int32)
        for i in np.flatnonzero(is_byte):
            self.byte_ids[int(pieces[i][3:5], 16)] = i
        # symbols: the pieces, then characters that pieces hold but that are none themselves
        self.symbol = {p: i for i, p in enumerate(pieces) if normal[i]}
        extra = sorted({c for p in self.symbol for c in p} - set(self.symbol))
        self.symbol |= {c: n + i for i, c in enumerate(extra)}
        self.first_other = n + len(extra)
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.first_other
        for p, i in self.symbol.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        self.crossing = any(SPACE in p.lstrip(SPACE) for p in self.symbol)
        score = {p: sp.get_score(i) for p, i in self.symbol.items() if i < n}
        ranks = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        pairs = [(self.symbol[p[:k]] << 32 | self.symbol[p[k:]], ranks[score[p]] << 32 | i) for p, i in self.symbol.items() if i < n for k in range(1, len(p)) if p[:k] in self.symbol and p[k:] in self.symbol]
        keys, values = (np.array(x, np.int64) for x in zip(*sorted(pairs), strict=True)) if pairs else (np.zeros(1, np.int64),) * 2
        self.bits = max(4, int(np.ceil(np.log2(len(keys)))) + 2)
        self._hash(keys, values)
        # decoding: a byte piece stands for its byte, a control piece for nothing
        raw = [bytes([int(p[3:5], 16)]) if is_byte[i] else b"" if self.control[i] else sp.decode([i]).encode() if i == self.unk else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        decimal = [b"%d," % i for i in range(n)]
        self.decimal = np.frombuffer(b"".join(decimal), np.uint8)
        self.decimal_at = np.concatenate([[0], np.cumsum([len(x) for x in decimal])]).astype(np.int64)
        self.is_byte = is_byte
        self.cache = C.WordCache(self.encode_words)

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table, probed a fixed number of steps."""
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, NONE, np.int64)
        slot = self._slot(keys)
        self.steps, left = 0, np.arange(len(keys))
        while len(left):
            self.steps += 1
            at = (slot[left] + self.steps - 1) & (size - 1)
            free = self.keys[at] == -1
            _, firsts = np.unique(np.where(free, at, -1), return_index=True)
            firsts = firsts[free[firsts]]
            self.keys[at[firsts]], self.values[at[firsts]] = keys[left[firsts]], values[left[firsts]]
            left = np.delete(left, firsts)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank << 32 | piece of each pair; NONE where it has no piece."""
        keys = left << 32 | right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.steps):
            there = self.keys[at[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (there != -1)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return out

    # -------------------------------------------------------------- encoding

    def words(self, text: str) -> list[str]:
        """The normalised text, cut before each white-space mark that follows another symbol."""
        if not text:
            return []
        text = self.normalize(text) if self.normalize else SPACE + text.replace(" ", SPACE)
        if self.crossing:
            return [text]
        parts = text.split(SPACE)
        if "" not in parts[1:]:
            return [SPACE + p for p in parts[1:]] if not parts[0] else [parts[0], *(SPACE + p for p in parts[1:])]
        out, lead = ([parts[0]] if parts[0] else []), 0
        for p in parts[1:]:
            lead += 1
            if p:
                out.append(SPACE * lead + p)
                lead = 0
        return [*out, SPACE * lead] if lead else out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, flat, and their offsets."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.of_char[codes]
        word = np.repeat(np.arange(len(words)), sizes)
        end, again = self._rounds(symbols, word, len(words), all_at_once=True)
        if again.any():
            redo = again[word]
            kept = ~again[end[1]]
            slow, _ = self._rounds(symbols[redo], word[redo], len(words), all_at_once=False)
            s, w = np.concatenate([end[0][kept], slow[0]]), np.concatenate([end[1][kept], slow[1]])
            order = np.argsort(w, kind="stable")
            end = s[order], w[order]
        return self._to_ids(*end, len(words))

    def _rounds(self, sym: np.ndarray, word: np.ndarray, n: int, all_at_once: bool) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """Merge until no pair remains. Returns the symbols with their words, and which words opened a lower rank while merging several pairs at once."""
        done_s, done_w, done_at = [], [], []
        again, at = np.zeros(n, bool), np.arange(len(sym))
        last = np.full(n, -1, np.int64)
        several = np.zeros(n, bool)
        value = self._values(sym, word, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(value, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            here = word[starts]
            again[here] |= several[here] & ((least >> 32) <= last[here]) & (least != NONE)
            live = least != NONE
            if not live.all():
                out = np.repeat(~live, sizes)
                done_s.append(sym[out])
                done_w.append(word[out])
                done_at.append(at[out])
                keep = ~out
                sym, word, value, at = sym[keep], word[keep], value[keep], at[keep]
                here, least, sizes = here[live], least[live], sizes[live]
                if not len(sym):
                    break
            last[here] = least >> 32
            low = np.repeat(least >> 32, sizes)
            hit = np.flatnonzero((value >> 32) == low)
            hit = hit[value[hit] != NONE]
            # of a run of overlapping pairs every second one merges, from the left
            run = np.concatenate([[True], np.diff(hit) > 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            if not all_at_once:
                hit = hit[np.concatenate([[True], word[hit][1:] != word[hit][:-1]])]
            several[:] = False
            if all_at_once:
                several |= np.bincount(word[hit], minlength=n) > 1
                # a merged pair beside the next one may open a lower rank that merging the next one hides
                near = hit[:-1][(np.diff(hit) == 2) & (word[hit[:-1]] == word[hit[1:]])]
                opened = self.pair(value[near] & 0xFFFFFFFF, sym[near + 2])
                again[word[near[opened >> 32 <= value[near] >> 32]]] = True
            sym[hit] = value[hit] & 0xFFFFFFFF
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word, value, at = sym[keep], word[keep], value[keep], at[keep]
            # only the pairs at and before a merged symbol are new
            moved = hit - np.arange(len(hit))
            new = np.zeros(len(sym), bool)
            new[moved] = new[np.maximum(moved - 1, 0)] = True
            moved = np.flatnonzero(new)
            value[moved] = self._values(sym, word, moved)
        if not done_s:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64)), again
        s, w, a = np.concatenate(done_s), np.concatenate(done_w), np.concatenate(done_at)
        order = np.argsort(a, kind="stable")
        return (s[order], w[order]), again

    def _values(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each place, the pair with the next symbol of the same word."""
        out = np.full(len(at), NONE, np.int64)
        inner = np.flatnonzero(at + 1 < len(sym))
        inner = inner[word[at[inner]] == word[at[inner] + 1]]
        out[inner] = self.pair(sym[at[inner]], sym[at[inner] + 1])
        return out

    def _to_ids(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        other = np.flatnonzero(sym >= self.size)
        if not len(other):
            return sym.astype(np.int32), C.row_counts(word, n)
        back = {v: k for k, v in self.symbol.items() if v >= self.size}
        made, counts = [], np.ones(len(sym), np.int64)
        for i in other:
            s = int(sym[i])
            c = back[s] if s in back else chr(s - self.first_other)
            made.append(self.byte_ids[list(c.encode("utf-8", "surrogatepass"))] if self.fallback else np.array([self.unk], np.int32))
            counts[i] = len(made[-1])
        at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        ids = np.empty(at[-1], np.int32)
        plain = np.ones(len(sym), bool)
        plain[other] = False
        ids[at[:-1][plain]] = sym[plain]
        for i, m in zip(other, made, strict=True):
            ids[at[i] : at[i + 1]] = m
        return ids, C.row_counts(np.repeat(word, counts), n)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and each text's offsets."""
        cut = [self.words(t or "") for t in texts]
        words = [w for x in cut for w in x]
        index = self.cache.lookup(words)
        ids, at = C.gather(self.cache.ids, self.cache.offsets, index)
        per = np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)
        return ids, at[per]

    # -------------------------------------------------------------- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The text of each row of ids."""
        data, at = C.gather(self.raw, self.raw_at, ids)
        whole = data.tobytes()
        split = bool(self.control[ids].any())  # a control piece between byte pieces parts them
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            part = whole[at[a] : at[b]]
            try:
                text = self._decode_runs(ids[a:b]) if split else part.decode()
            except UnicodeDecodeError:
                text = self._decode_runs(ids[a:b])
            lead = a
            while lead < b and self.control[ids[lead]]:
                lead += 1
            if lead < b and not self.is_byte[ids[lead]] and ids[lead] != self.unk and text.startswith(" "):
                text = text[1:]  # the prefix that encoding adds
            out.append(text)
        return out

    def _decode_runs(self, ids: np.ndarray) -> str:
        """Byte pieces make text only with their neighbours of the same kind."""
        cut = np.flatnonzero(np.diff(self.is_byte[ids])) + 1
        return "".join(C.gather(self.raw, self.raw_at, part)[0].tobytes().decode("utf-8", "gleanery_one_each") for part in np.split(ids, cut))

    def digests(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """SHA-256 of the decimal ids of each row, joined by commas."""
        data, at = C.gather(self.decimal, self.decimal_at, ids)
        whole = memoryview(data.tobytes())
        return [hashlib.sha256(whole[at[a] : max(at[a], at[b] - 1)]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def codec(model_file: str) -> PieceCodec:
    return PieceCodec(model_file)


def _encode(batches: Iterator[pa.RecordBatch], model: str, digest: bool) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    c = codec(public_tokenizers.path(model) if "/" not in model else model)
    for batch in batches:
        for part in C.slices(batch, "text"):
            ids, at = c.encode(C.column(part, "text").to_pylist())
            texts = c.decode(ids, at)
            n = pa.array(np.diff(at), pa.int64())
            if digest:
                sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([C.column(part, "doc_id"), n, pa.array(c.digests(ids, at), pa.string()), pa.array(sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([C.column(part, "doc_id"), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def encode_decode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, decoded string of each row, with a model of public_tokenizers or a path every executor has."""
    return _apply(docs, model, id_col, text_col, False, "doc_id long, ids array<int>, decoded string")


def encode_decode_digest(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_decode`, with n_tokens and the SHA-256 digests of ids and decoded text in place of them."""
    return _apply(docs, model, id_col, text_col, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _apply(docs: DataFrame, model: str, id_col: str, text_col: str, digest: bool, schema: str) -> DataFrame:
    cols = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return cols.mapInArrow(lambda it: C.trimmed(_encode(it, model, digest)), schema)
