"""Token ids as binary segments of patched frame-of-reference blocks.

A document's ids are cut into blocks of 128. A block stores its minimum, and the
differences to it packed at the width that covers ``PERCENTILE`` per cent of
them; the few larger ones are exceptions, kept with their place in a list of
their own, and hold 0 in the packed part. A segment is one byte string:

    magic "GPF2", numbers of documents, blocks, words and exceptions (4 x u64)
    doc_id i64 each, known u8 each (0: null id), n_tokens u32 each
    index: first block of each document u32, first token of each document u64,
        first word u32 and first exception u32 of each block
    block minimum u32 each, width u8 each, exceptions u8 each
    packed words u64 each, in block order
    exceptions: place u8 each, difference u32 each

With the index a document's blocks are found and unpacked without a look at any
other block (:func:`picked`). Segments lie in a Parquet table (part, seq, start,
n_docs, n_tokens, first_id, last_id, segment): part is a range of ids and seq a
segment's number in it, start the ids before it in its part, and first_id and
last_id the least and largest id that isn't null, so ``read(..., only=ids)``
opens the segments that may hold these documents alone. The table gets written
by Spark's own committer, to any store that Spark reaches.

Encoding and packing are done where texts are read, and what is shuffled by id
ranges are packed blocks. Range bounds come from the id column alone. The
tokenizer sees each distinct white-space-free word once for each worker, up to
a bound, if its rules never look across ASCII white space (which is read from
its file, :func:`parts_at_spaces`), and whole texts otherwise.

Defined results: a null or empty text has the end id alone; null ids come first;
repeated rows and ids are written next to each other; an empty table gives no
segments and no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import common as C

BLOCK = 128
PERCENTILE = 98
SEGMENT_TOKENS = 1 << 18
MAGIC = b"GPF2"
#: Words that a worker keeps the ids of: some 200 bytes each.
CACHED_WORDS = 1_000_000
STARTS = ("word_at", "exc_at")
#: Lists of a segment: name, type, and what there is one of them for (0: documents, 1: blocks, 2: words, 3: exceptions).
LAYOUT = [("ids", np.int64, 0), ("known", np.uint8, 0), ("sizes", np.uint32, 0), ("block_at", np.uint32, 0), ("token_at", np.uint64, 0), ("word_at", np.uint32, 1), ("exc_at", np.uint32, 1), ("least", np.uint32, 1), ("width", np.uint8, 1), ("n_exc", np.uint8, 1), ("words", np.uint64, 2), ("place", np.uint8, 3), ("extra", np.uint32, 3)]
#: The lists that documents carry until segments are made.
MOVED = [x for x in LAYOUT if x[2] and x[0] not in STARTS]


# ------------------------------------------------------------------ blocks


def _bits(x: np.ndarray) -> np.ndarray:
    """Bits that each number needs."""
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def _word_counts(counts: np.ndarray, width: np.ndarray) -> np.ndarray:
    return (counts * width + 63) // 64


def block_counts(sizes: np.ndarray) -> np.ndarray:
    """Numbers in each block of documents of ``sizes`` ids."""
    blocks = (sizes + BLOCK - 1) // BLOCK
    out = np.full(blocks.sum(), BLOCK, np.int64)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    out[ends] = (sizes - (blocks - 1) * BLOCK)[blocks > 0]
    return out


def pack(ids: np.ndarray, sizes: np.ndarray) -> dict[str, np.ndarray]:
    """The block lists of documents whose ids lie one after the other."""
    counts = block_counts(sizes)
    n = len(counts)
    start = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), counts)
    col = np.arange(len(ids)) - start[row]
    ids = ids.astype(np.uint32)
    least = np.minimum.reduceat(ids, start) if n else np.zeros(0, np.uint32)
    grid = np.zeros((n, BLOCK), np.uint32)
    grid[row, col] = ids - least[row]
    ranked = np.sort(grid, 1)  # the padding's zeros come first
    at = BLOCK - counts + np.minimum(counts * PERCENTILE // 100, counts - 1)
    width = _bits(ranked[np.arange(n), at]) if n else np.zeros(0, np.int64)
    exc_row, exc_col = np.nonzero(grid >> np.minimum(width, 31).astype(np.uint32)[:, None] >> (width > 31).astype(np.uint32)[:, None])
    extra = grid[exc_row, exc_col]
    grid[exc_row, exc_col] = 0
    word_n = _word_counts(counts, width)
    word_at = np.concatenate([[0], np.cumsum(word_n)]).astype(np.int64)
    words = np.zeros(word_at[-1], np.uint64)
    for w in np.unique(width):
        if not w:
            continue
        pick = np.flatnonzero(width == w)
        out = np.zeros((2 * w + 1, len(pick)), np.uint64)
        values = grid[pick].T.astype(np.uint64)
        for i in range(BLOCK):
            k, s = divmod(i * int(w), 64)
            out[k] |= values[i] << np.uint64(s)
            if s + w > 64:
                out[k + 1] |= values[i] >> np.uint64(64 - s)
        used = word_n[pick]
        r = np.repeat(np.arange(len(pick)), used)
        c = np.arange(used.sum()) - np.repeat(np.cumsum(used) - used, used)
        words[word_at[pick][r] + c] = out[c, r]
    return {"least": least.astype(np.uint32), "width": width.astype(np.uint8), "n_exc": np.bincount(exc_row, minlength=n).astype(np.uint8), "words": words, "place": exc_col.astype(np.uint8), "extra": extra.astype(np.uint32)}


def unpack(lists: dict[str, np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """The ids that :func:`pack` was given."""
    counts = block_counts(sizes.astype(np.int64))
    n = len(counts)
    width = lists["width"].astype(np.int64)
    word_n = _word_counts(counts, width)
    word_at = np.cumsum(word_n) - word_n
    words = np.concatenate([lists["words"], np.zeros(1, np.uint64)])
    grid = np.zeros((BLOCK, n), np.int64)
    for w in np.unique(width):
        if not w:
            continue
        pick = np.flatnonzero(width == w)
        mask = np.uint64((1 << int(w)) - 1)
        base, last = word_at[pick], len(words) - 1
        values = np.empty((BLOCK, len(pick)), np.int64)
        for i in range(BLOCK):
            k, s = divmod(i * int(w), 64)
            v = words[np.minimum(base + k, last)] >> np.uint64(s)
            if s + w > 64:
                v = v | (words[np.minimum(base + k + 1, last)] << np.uint64(64 - s))
            values[i] = (v & mask).astype(np.int64)
        grid[:, pick] = values
    exc_row = np.repeat(np.arange(n), lists["n_exc"])
    grid[lists["place"], exc_row] = lists["extra"]
    grid += lists["least"].astype(np.int64)[None, :]
    row = np.repeat(np.arange(n), counts)
    col = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return grid[col, row]


def picked(lists: dict[str, np.ndarray], docs: np.ndarray) -> dict[str, np.ndarray]:
    """The block lists of some documents of a segment, by the places of these: what the index points to, and nothing else, is read."""
    bounds = {1: _starts(lists["block_at"], len(lists["least"]))}
    out = {name: lists[name][docs] for name, _, k in LAYOUT if not k}
    from_, to = bounds[1][docs], bounds[1][docs + 1]
    for k, of, total in ((2, "word_at", len(lists["words"])), (3, "exc_at", len(lists["place"]))):
        edges = _starts(lists[of], total)
        bounds[k] = np.stack([edges[from_], edges[to]])
    bounds[1] = np.stack([from_, to])
    for name, _, k in LAYOUT:
        if k:
            out[name] = np.concatenate([lists[name][a:b] for a, b in zip(*bounds[k].tolist(), strict=True)]) if len(docs) else lists[name][:0]
    return out


def _starts(starts: np.ndarray, end: int) -> np.ndarray:
    return np.append(starts, end).astype(np.int64)


def indexed(lists: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Lists with where documents and blocks start."""
    sizes = lists["sizes"].astype(np.int64)
    before = lambda x: np.cumsum(x) - x
    words = _word_counts(block_counts(sizes), lists["width"].astype(np.int64))
    return lists | {"block_at": before((sizes + BLOCK - 1) // BLOCK), "token_at": before(sizes), "word_at": before(words), "exc_at": before(lists["n_exc"].astype(np.int64))}


def to_segment(lists: dict[str, np.ndarray]) -> bytes:
    lists = indexed(lists)
    heads = np.array([len(lists["ids"]), len(lists["least"]), len(lists["words"]), len(lists["place"])], np.uint64)
    return b"".join([MAGIC, heads.tobytes(), *(np.ascontiguousarray(lists[name], kind).tobytes() for name, kind, _ in LAYOUT)])


def from_segment(data: bytes) -> dict[str, np.ndarray]:
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    heads = np.frombuffer(data, np.uint64, 4, 4)
    at, out = 36, {}
    for name, kind, k in LAYOUT:
        out[name] = np.frombuffer(data, kind, int(heads[k]), at)
        at += out[name].nbytes
    return out


# ------------------------------------------------------------------ encoding

#: A fixed value: a public pattern of pre-tokens, which ends a run of letters before any ASCII mark.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() for i in range(256)])


class WordTokenizer:
    """Ids of whole texts from those of their words, where the tokenizer never looks across ASCII white space; else text by text."""

    def __init__(self, file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = self.tokenizer.get_added_tokens_decoder().items()
        special = [t for t in added if t[1].special and not t[1].normalized]
        #: A special token parts a text before anything else looks at it, so words joined by it are encoded each for itself.
        self.cut_id, self.cut = (special[0][0], special[0][1].content) if special else (None, None)
        self.marks = [t[1].content.encode() for t in special]
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = parts_at_spaces(spec)
        first = next(iter(_rules(spec.get("pre_tokenizer"), "pretokenizers")), {})
        self.cuts_letters = self.by_word and first.get("pattern") == {"Regex": LETTER_RUNS}
        self.lowers = self.by_word and any(x["type"] == "Lowercase" for x in _rules(spec.get("normalizer"), "normalizers"))
        self.cache = C.SpanCache(self._encode, CACHED_WORDS)

    def _each(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in texts], add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum([len(x) for x in got])]).astype(np.int64)
        return np.fromiter((i for x in got for i in x), np.int32, int(at[-1])), at

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.cut is None or any(m in b" ".join(words) for m in self.marks):
            return self._each(words)
        joined = self.cut.join(w.decode() for w in words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
        cuts = np.flatnonzero(ids == self.cut_id)
        ends = np.append(cuts, len(ids)) - np.arange(len(words))
        return ids[ids != self.cut_id], np.concatenate([[0], ends]).astype(np.int64)

    def _words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bytes, and the spans in them that are encoded each for itself: words, and what follows their letters, where the rules cut there anyway."""
        low = C.lower_ascii(data) if self.lowers else data
        if not self.cuts_letters or any(m in low.tobytes() for m in self.marks):
            return data, *C.spans(data, offsets)
        starts, ends, rows = C.spans(low, offsets)
        cuts = np.flatnonzero(_LETTER[low[:-1]] & _MARK[low[1:]]) + 1
        cuts = cuts[~np.isin(cuts, offsets)]
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return low, starts, ends, np.searchsorted(offsets, starts, "right") - 1

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end_id``, and the sizes."""
        n = len(offsets) - 1
        if self.by_word:
            data, starts, ends, rows = self._words(data, offsets)
            places = self.cache.lookup(data, starts, ends)  # which may move the arrays
            ids, at = C.gather(self.cache.ids, self.cache.offsets, places)
            at = at[C.row_counts(rows, n)]
        else:
            raw = data.tobytes()
            ids, at = self._each([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        sizes = np.diff(at) + 1
        out = np.full(len(ids) + n, end_id, np.int32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(sizes) - 1] = False
        out[inner] = ids
        return out, sizes


def _rules(x: dict | None, inner: str) -> list[dict]:
    """The steps of a normaliser or pre-tokeniser, one after the other."""
    return [] if x is None else [y for part in x[inner] for y in _rules(part, inner)] if x["type"] == "Sequence" else [x]


def parts_at_spaces(spec: dict) -> bool:
    """Whether a tokenizer file's rules treat each run between ASCII white space for itself, wherever it stands.

    So they do if normalisers change single characters or collapse white space,
    if the first step of the pre-tokeniser cuts at white space and drops it, and
    if no added token holds any or strips what is beside it.
    """

    def fine(x: dict) -> bool:
        return x["type"] in ("NFC", "NFKC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " "

    def cuts(x: dict) -> bool:
        if x["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
            return True
        # what matches is kept and the rest dropped: nothing that may match holds white space, as none of the parts of the pattern names it
        told = x.get("pattern", {}).get("Regex", "")
        return x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"] and r"[^\s" in told and not any(p in told.replace(r"[^\s", "") for p in (r"\s", " ", ".", r"\W", r"\S"))

    before = _rules(spec.get("pre_tokenizer"), "pretokenizers")
    return all(map(fine, _rules(spec.get("normalizer"), "normalizers"))) and bool(before) and cuts(before[0]) and all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))


@lru_cache(maxsize=2)
def tokenizer(name: str) -> WordTokenizer:
    import public_tokenizers

    return WordTokenizer(name if "/" in name else public_tokenizers.path(name))


def _cut(lists: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary array of the pieces of ``lists`` between offsets."""
    data = np.ascontiguousarray(lists)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def _encode_packed(batches: Iterator[pa.RecordBatch], model: str, end_id: int, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    t = tokenizer(model)
    for batch in batches:
        for part in C.slices(batch, "text"):
            ids, sizes = t.encode(*C.flat(C.column(part, "text")), end_id)
            got = pack(ids, sizes)
            blocks = np.concatenate([[0], np.cumsum((sizes + BLOCK - 1) // BLOCK)]).astype(np.int64)
            words = np.concatenate([[0], np.cumsum(_word_counts(block_counts(sizes), got["width"].astype(np.int64)))])[blocks]
            excs = np.concatenate([[0], np.cumsum(got["n_exc"].astype(np.int64))])[blocks]
            key = C.column(part, "doc_id")
            place = np.searchsorted(bounds, key.fill_null(np.iinfo(np.int64).min).to_numpy(), "right")
            at = {1: blocks, 2: words, 3: excs}
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), key, pa.array(sizes, pa.int64()), *(_cut(got[name], at[k]) for name, _, k in MOVED)], ["part", "doc_id", "n_tokens", *(name for name, _, _ in MOVED)])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and id, gathered into segments of about SEGMENT_TOKENS ids."""
    held: list[pa.RecordBatch] = []
    now, seq, start, tokens = None, 0, 0, 0

    def flush() -> pa.RecordBatch:
        nonlocal held, seq, start, tokens
        t = pa.Table.from_batches(held).combine_chunks()
        lists = {name: np.frombuffer(C.flat(t.column(name))[0].tobytes(), kind) for name, kind, _ in MOVED}
        key = t.column("doc_id")
        lists |= {"ids": key.fill_null(0).to_numpy(), "known": key.is_valid().to_numpy().astype(np.uint8), "sizes": t.column("n_tokens").to_numpy()}
        span = pc.min_max(key)
        row = [now, seq, start, t.num_rows, tokens, span["min"].as_py(), span["max"].as_py(), to_segment(lists)]
        seq, start, tokens, held = seq + 1, start + tokens, 0, []
        kinds = [pa.int32(), *[pa.int64()] * 6, pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "start", "n_docs", "n_tokens", "first_id", "last_id", "segment"])

    for batch in batches:
        parts, sizes = C.column(batch, "part").to_numpy(), C.column(batch, "n_tokens").to_numpy()
        at = 0
        while at < len(parts):
            if parts[at] != now:
                if held:
                    yield flush()
                now, seq, start, tokens = int(parts[at]), 0, 0, 0
            same = np.flatnonzero(parts[at:] != now)
            stop = at + int(same[0]) if len(same) else len(parts)
            full = int(np.searchsorted(np.cumsum(sizes[at:stop]), SEGMENT_TOKENS - tokens, "left")) + 1
            to = min(stop, at + full)
            held.append(batch.slice(at, to - at))
            tokens += int(sizes[at:to].sum())
            at = to
            if tokens >= SEGMENT_TOKENS:
                yield flush()
    if held:
        yield flush()


def write(docs: DataFrame, path: str | None = None, model: str = "word_bpe_49k.json", end_id: int = 1, n_parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the segments of all documents, in ascending order of ids, and return the table's path."""
    spark = C.importable(docs.sparkSession)
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*(F.lit(k / n_parts) for k in range(1, n_parts)))
    bounds = base.agg(F.percentile_approx("doc_id", shares, F.lit(10 * n_parts)).alias("b")).first()["b"] if n_parts > 1 else []
    bounds = np.unique(np.array(bounds or [], np.int64))
    schema = "part int, doc_id long, n_tokens long, " + ", ".join(f"{name} binary" for name, _, _ in MOVED)
    packed = base.mapInArrow(lambda it: _encode_packed(it, model, end_id, bounds), schema)
    dealt = packed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "n_tokens", "words")
    path = path or f"{C.shared_dir(spark)}/gleanery/tokens-{uuid.uuid4().hex}"
    dealt.mapInArrow(_segments, "part int, seq long, start long, n_docs long, n_tokens long, first_id long, last_id long, segment binary").write.option("compression", "uncompressed").parquet(path)
    return path


# ------------------------------------------------------------------ reading


def _read(batches: Iterator[pa.RecordBatch], digest: bool, only: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            lists = from_segment(C.column(batch, "segment")[i].as_py())
            if only is not None:
                docs = np.flatnonzero(np.isin(lists["ids"], only) & (lists["known"] == 1))
                if not len(docs):
                    continue
                lists = picked(lists, docs)
            sizes = lists["sizes"].astype(np.int64)
            begin = C.column(batch, "start")[i].as_py() + C.column(batch, "base")[i].as_py() + lists["token_at"].astype(np.int64)
            ids = unpack(lists, sizes)
            at = np.concatenate([[0], np.cumsum(sizes)])
            key = pa.array(lists["ids"], mask=lists["known"] == 0)
            if digest:
                raw = memoryview(ids.astype("<u4").tobytes())
                last = pa.array([zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())
            else:
                last = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([key, pa.array(begin, pa.int64()), pa.array(sizes), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def read(spark: SparkSession, path: str, digest: bool = False, only: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens and ids (or their crc32) of each document of a segment table, or of those whose ids are in ``only``."""
    wanted = None if only is None else np.array(only, np.int64)
    table = spark.read.parquet(path)
    totals = sorted(table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # one row per part
    bases, total = {}, 0
    for part, n in totals:
        bases[part], total = total, total + n
    base = F.element_at(F.create_map(*(F.lit(x) for k, v in bases.items() for x in (k, v))), F.col("part")).cast("long") if bases else F.lit(0).cast("long")
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>")
    if only is not None:
        asked = F.array(*(F.lit(int(x)) for x in only)) if len(only) else F.array().cast("array<bigint>")
        table = table.where(F.exists(asked, lambda x: (x >= F.col("first_id")) & (x <= F.col("last_id"))))
    return table.select("start", base.alias("base"), "segment").mapInArrow(lambda it: _read(it, digest, wanted), schema)
