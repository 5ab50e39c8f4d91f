"""N-gram Jaccard join: groups of documents linked by shingle sets of high Jaccard likeness, exactly.

1. *Sets.* Each text becomes the set of its distinct n-word shingles, as hashes
   in ascending order. Texts of equal sets form one class, for which the smallest
   id stands; the rest works on one document of each class.
2. *Candidates.* Linked sets of sizes a and b share t * max(a, b) shingles at
   least. A set emits its prefix: its e least hashes, e being the number of
   shingles that it may lack (a less t * a, rounded up), and e + 1 more. Of two
   linked sets the prefixes then share as many as the smaller one's extra part
   has: the l-th least common hash has t * a - l others behind it. Hashes that
   several documents emit are counted; who holds fewer of them than a partner
   must share (some two fifths of the prefix) has no partner, which rules out
   documents that have a passage or frequent phrases in common. Of the c that
   it holds, a document of need r keeps the c - r + 1 rarest: by the same
   argument, in the order of frequency, linked documents still share one. Each
   document is joined to the smallest one for every hash it kept; the components
   of these pairs hold every true link, and their texts are fetched once.
3. *Signature trees.* The documents of a component, or of a block of it if it is
   large, form a tree over their sizes and tokens: leaves hold the bitmap of a
   document's shingles over the block's own dictionary, inner nodes the OR of
   their children's and their range of sizes. A dual traversal drops a pair of
   nodes when the overlap of their bitmaps can't reach the threshold for any
   sizes in their ranges; at the leaves the overlap is the exact one. Pairs
   that are already connected are not looked at.
4. *Large components.* Blocks are of bounded size, and documents of one least
   kept hash (near copies, mostly) lie in the same block. First each block is
   joined in itself; then the best-linked documents, and then those outside the
   largest class found so far, go to other blocks of their component: only to
   those where a document of another class kept a hash that they kept. Pairs
   inside one class need no look, so a group of near copies costs little more
   than a pass over it.

Defined results: a null text or one without words has the empty set, no links
and itself as component; a text with fewer words than n has its whole sequence
as one shingle; repeated rows and equal sets share a component; a null id names
no document, so its rows carry no links and have a null component; ids that
stand on several rows stand for the union of their rows' links; an empty table
gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import common as C
from gleanery.operators.components import components

#: Hashes that a prefix has at least beyond those that its set may lack, as far as there are any: short texts emit all.
EXTRA = 32
#: Documents and bytes of text in a block; a component beyond is split.
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Best-linked documents of a large component that go to other blocks first.
PIVOTS = 32
FANOUT = 8
#: Blocks in a list of those that hold a hash.
LISTED = 256


# ------------------------------------------------------------------ shingle sets


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    data, offsets = C.flat(column)
    low = C.lower_ascii(data)
    starts, ends, rows = C.spans(low, offsets)
    hashes = C.span_hashes(low, starts, ends)
    return C.unique_in_rows(*C.shingles(hashes, C.row_counts(rows, len(offsets) - 1), n))


def prefixes(size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a set's least hashes it emits, and how many of them a linked set emits too at least."""

    def extra(a: np.ndarray) -> np.ndarray:
        least = -(-a * percent // 100)
        return np.minimum(np.maximum(a - least + 1, EXTRA), np.maximum(least, 1))

    least = -(-size * percent // 100)
    emits = np.minimum(size, size - least + extra(size))
    # a set that one more member would take below the threshold has no partner but its equals
    return np.where(100 * size >= percent * (size + 1), emits, 0), extra(least)


def _profile(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in C.slices(batch, "text"):
            values, at = shingle_sets(C.column(part, "text"), n)
            size = np.diff(at)
            hashes = []
            for salt in (1, 2):
                total = np.concatenate([[np.uint64(0)], np.cumsum(C.mix(values + np.uint64(salt)), dtype=np.uint64)])
                hashes.append(C.mix((total[at[1:]] - total[at[:-1]]) ^ size.astype(np.uint64)).view(np.int64))
            _, offsets = C.flat(C.column(part, "text"))
            emits, need = prefixes(size, percent)
            inside = np.arange(len(values)) - np.repeat(at[:-1], size) < np.repeat(emits, size)
            ends = np.concatenate([[0], np.cumsum(emits)]).astype(np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[inside].view(np.int64)))
            yield pa.RecordBatch.from_arrays([C.column(part, "doc_id"), C.column(part, "times"), pa.array(size), pa.array(np.diff(offsets)), *map(pa.array, hashes), pa.array(need.astype(np.int32)), sigs], ["doc_id", "times", "n_shingles", "n_bytes", "h1", "h2", "need", "sigs"])


# ------------------------------------------------------------------ signature trees


class _Union:
    """Union-find over places of a block."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.root[self.root], self.root):
            self.root = up
        return self.root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect many pairs: every root takes the least root that it meets, until none changes."""
        while len(a):
            r = self.roots()
            a, b = r[a], r[b]
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.root, high, low)


def reaches(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of at least ``a`` and ``b`` members may share ``overlap`` of them and link."""
    union = np.maximum(a, overlap) + np.maximum(b, overlap) - overlap
    return (100 * overlap >= percent * union) & (overlap > 0)


class SignatureTree:
    """Levels of nodes over documents sorted by size and tokens; level 0 has the documents."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        self.size = np.diff(offsets)
        n = len(self.size)
        dictionary, token = np.unique(values, return_inverse=True)
        rows = np.repeat(np.arange(n), self.size)
        # tokens that one document alone has can't be shared: they count in sizes only
        often = np.bincount(token, minlength=len(dictionary)) > 1
        name = np.cumsum(often) - 1
        kept = often[token]
        token, rows = name[token[kept]], rows[kept]
        first = np.full(n, len(dictionary), np.int64)
        np.minimum.at(first, rows, token)
        order = np.lexsort((first, self.size))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        words = max(1, (int(often.sum()) + 63) // 64)
        self.order = order
        low = self.size[order]
        bits = np.zeros((n, words), np.uint64)
        np.bitwise_or.at(bits, (place[rows], token >> 6), np.uint64(1) << (token & 63).astype(np.uint64))
        self.levels = [(bits, low, low)]
        while len(bits) > 1:
            cut = np.arange(0, len(bits), FANOUT)
            bits = np.bitwise_or.reduceat(bits, cut)
            self.levels.append((bits, np.minimum.reduceat(self.levels[-1][1], cut), np.maximum.reduceat(self.levels[-1][2], cut)))

    def links(self, percent: int, union: _Union, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Join ``union`` by all links between documents (places before sorting), and return the links that were looked at.

        ``left``: a flag for each document; only pairs with one flagged document count.
        """
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        flag = left[self.order] if left is not None else None
        found_a, found_b = [], []
        while todo:
            level, a, b = todo.pop()
            bits, low, high = self.levels[level]
            most = max(1, (8 << 20) // bits.shape[1] // 8)
            if len(a) > most:
                todo += [(level, a[k : k + most], b[k : k + most]) for k in range(0, len(a), most)][::-1]
                continue
            if not level:
                keep = a < b
                if flag is not None:
                    keep &= flag[a] | flag[b]
                roots = union.roots()
                keep &= roots[self.order[a]] != roots[self.order[b]]
                a, b = a[keep], b[keep]
            if not len(a):
                continue
            shared = np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64)
            may = reaches(np.minimum(shared, np.minimum(high[a], high[b])), low[a], low[b], percent)
            a, b = a[may], b[may]
            if not level:
                found_a.append(self.order[a])
                found_b.append(self.order[b])
                union.join(self.order[a], self.order[b])
                continue
            below = len(self.levels[level - 1][0])
            kids = np.arange(FANOUT)
            ka = (a[:, None, None] * FANOUT + kids[None, :, None]).repeat(FANOUT, 2).ravel()
            kb = (b[:, None, None] * FANOUT + kids[None, None, :]).repeat(FANOUT, 1).ravel()
            fine = (ka < below) & (kb < below) & (ka <= kb)
            todo.append((level - 1, ka[fine], kb[fine]))
        return np.concatenate([*found_a, np.zeros(0, np.int64)]), np.concatenate([*found_b, np.zeros(0, np.int64)])


def _blocks(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Join each block, whose rows follow each other in the partition; yields each document's least partner class and its links."""
    held: list[pa.Table] = []
    for batch in batches:
        key = C.column(batch, "block").to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if held and held[-1].column("block")[0].as_py() != int(key[a]):
                yield from _solve(pa.concat_tables(held), n, percent)
                held = []
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield from _solve(pa.concat_tables(held), n, percent)


def _solve(block: pa.Table, n: int, percent: int) -> Iterator[pa.RecordBatch]:
    block = block.combine_chunks()
    ids, classes = block.column("doc_id").to_numpy(), block.column("class").to_numpy()
    if len(ids) < 2:
        return
    parts = []
    for batch in block.select(["text"]).to_batches():
        for piece in C.slices(batch, "text"):
            parts.append(shingle_sets(C.column(piece, "text"), n))
    values = np.concatenate([v for v, _ in parts])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in parts]))]).astype(np.int64)
    left = block.column("probe").to_numpy(zero_copy_only=False).astype(bool)
    union = _Union(len(ids))
    order = np.argsort(classes, kind="stable")  # what earlier rounds connected
    same = np.flatnonzero(classes[order][1:] == classes[order][:-1])
    union.join(order[same], order[same + 1])
    a, b = SignatureTree(values, offsets).links(percent, union, None if left.all() else left)
    degree = np.bincount(np.concatenate([a, b]), minlength=len(ids))
    roots = union.roots()
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, roots, classes)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(classes), pa.array(least[roots]), pa.array(degree)], ["doc_id", "class", "least", "degree"])


# ------------------------------------------------------------------ the operator


def _grouped(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of doc_id, text, class, probe and block, solved block by block."""
    dealt = rows.repartition("block").sortWithinPartitions("block", F.xxhash64("doc_id", F.lit(5)), "doc_id")
    return dealt.select("block", "doc_id", "class", "probe", "text").mapInArrow(lambda it: C.trimmed(_blocks(it, n, percent)), "doc_id long, class long, least long, degree long")


def _merged(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` (doc_id, class, ...) with the classes that ``found`` connects made one."""
    edges = found.where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    top = components(edges, "a", "b").select(F.col("node").alias("class"), "component")
    return members.join(top, "class", "left").withColumn("class", F.coalesce("component", "class")).drop("component")


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of each row: the smallest id that links reach.

    Sets of ``n``-word shingles link when their Jaccard likeness is ``percent``
    or more per hundred.
    """
    C.importable(docs.sparkSession)
    all_texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    texts = all_texts.select("doc_id", "text", F.lit(1).cast("long").alias("times"))
    repeated = not all_texts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        # rows of equal id and text are worked on once, however many there are; rows of null ids stay apart
        once = all_texts.where("doc_id is not null").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
        texts = C.materialize(once.unionAll(texts.where("doc_id is null")), "jaccard-once")
    profile = C.materialize(texts.mapInArrow(lambda it: C.trimmed(_profile(it, n, percent)), "doc_id long, times long, n_shingles long, n_bytes long, h1 long, h2 long, need int, sigs array<long>"), "jaccard-profile")
    filled = profile.where("n_shingles > 0 and doc_id is not null")
    # equal sets: partial aggregation meets copies where they lie
    key = ["n_shingles", "h1", "h2"]
    reps = C.materialize(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    classes = filled.select("doc_id", "times", "n_bytes", *key).join(reps, key).select("doc_id", "times", "n_bytes", "n_shingles", "rep")
    alone = profile.where("n_shingles = 0 or doc_id is null").select("doc_id", "times", "n_bytes", "n_shingles", F.col("doc_id").alias("rep"))
    classes = C.materialize(classes.unionAll(alone), "jaccard-sets")
    own = filled.select("doc_id", "need", "sigs").join(reps.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    own = C.materialize(own, "jaccard-own")
    C.release(profile, reps)

    kept = _kept(own)
    C.release(own)
    least = C.materialize(kept.groupBy("sig").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("sig", "least"), "jaccard-least")
    edges = kept.join(least.hint("merge"), "sig").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    found = components(edges, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("comp"))
    each = kept.groupBy("doc_id").agg(F.collect_list("sig").alias("sigs"))
    weight = classes.where("doc_id is not null").groupBy("doc_id").agg(F.sum("n_bytes").alias("n_bytes"))
    placed = C.materialize(found.join(each, "doc_id").join(weight, "doc_id").withColumn("lead", F.array_min("sigs")), "jaccard-weights")
    n_placed = placed.count()
    members = _parted(placed, n_placed)
    C.release(kept, least)

    with_text = C.materialize(texts.select("doc_id", "text").join(C.sized(members, n_placed), "doc_id").select(*members.columns, "text"), "jaccard-texts")
    local = C.materialize(_grouped(with_text.withColumn("block", F.xxhash64("comp", "part")).withColumn("probe", F.lit(True)), n, percent), "jaccard-local")
    members = C.materialize(_merged(members, local), "jaccard-classes")
    large = members.where("n_blocks > 1")
    if not large.isEmpty():
        signs = C.materialize(placed.select("doc_id", "sigs").join(C.sized(large.select("doc_id", "comp", "part"), n_placed), "doc_id"), "jaccard-signs")
        # The documents with most links of each block, PIVOTS for a component.
        degrees = local.select("doc_id", "degree").join(C.sized(large, n_placed), "doc_id")
        in_part = Window.partitionBy("comp", "part").orderBy(F.desc("degree"), "doc_id")
        in_comp = Window.partitionBy("comp").orderBy(F.desc("degree"), "doc_id")
        pivots = degrees.withColumn("r", F.row_number().over(in_part)).where(F.col("r") <= 1).withColumn("r", F.row_number().over(in_comp)).where(F.col("r") <= PIVOTS)
        members = C.materialize(_merged(members, _against(with_text, members, n_placed, signs, pivots.select("doc_id"), n, percent)), "jaccard-pivoted")
        # What lies outside the largest class of its component meets what it may link to.
        large = members.where("n_blocks > 1")
        counts = large.groupBy("comp", "class").agg(F.count("*").alias("n"))
        main = counts.groupBy("comp").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
        rest = large.join(C.sized(main, n_placed), "comp").where("class <> main").select("doc_id")
        members = C.materialize(_merged(members, _against(with_text, members, n_placed, signs, rest, n, percent)), "jaccard-classes")
        C.release(signs)
    C.release(placed, with_text, local)

    top = C.sized(members.select(F.col("doc_id").alias("rep"), F.col("class").alias("component_id")), n_placed)
    # classes take the smallest id of their representatives, and these the smallest of their sets
    comp = classes.join(top, "rep", "left").select("doc_id", "times", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    several = comp.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.max("component_id").alias("most")).where("least < most")
    if repeated and not several.isEmpty():  # an id on several rows connects their components
        pairs = comp.join(several, "doc_id").where("component_id <> least").select(F.col("component_id").alias("a"), F.col("least").alias("b"))
        up = components(pairs, "a", "b").select(F.col("node").alias("component_id"), F.col("component").alias("up"))
        comp = comp.join(up, "component_id", "left").select("doc_id", "times", "n_shingles", F.coalesce("up", "component_id").alias("component_id"))
    return comp.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("doc_id", "n_shingles", "component_id")


def _kept(own: DataFrame) -> DataFrame:
    """sig and doc_id: of the hashes in ``own`` (doc_id, need, sigs) that several documents emit, those that each document keeps."""
    emitted = own.select("doc_id", "need", F.explode("sigs").alias("sig"))
    # counted before they are joined, and by a shuffle at every size: a hash that very many documents have meets in no task
    shared = C.materialize(emitted.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1"), "jaccard-shared")
    held = C.materialize(emitted.join(shared.hint("merge"), "sig"), "jaccard-held")
    C.release(shared)
    each = Window.partitionBy("doc_id")
    rank = F.row_number().over(each.orderBy("n", "sig"))
    counted = held.withColumn("rank", rank).withColumn("c", F.count("*").over(each)).withColumn("need", F.min("need").over(each))
    kept = C.materialize(counted.where("c >= need and rank <= c - need + 1").select("sig", "doc_id"), "jaccard-kept")
    C.release(held)
    return kept


def _pieces(rows: Column, size: Column) -> Column:
    """Blocks or chunks that ``rows`` documents of ``size`` bytes make."""
    return F.greatest(F.ceil(rows / BLOCK_DOCS), F.ceil(size / BLOCK_BYTES)).cast("int")


def _parted(members: DataFrame, n_members: int) -> DataFrame:
    """``n_members`` documents (doc_id, comp, lead, n_bytes) with the part of their component: one, or for a large one a part for each common lead and bins for the others."""
    total = lambda of: members.groupBy(*of).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"))
    sizes = total(["comp"]).select("comp", _pieces(F.col("n"), F.col("size")).alias("n_blocks"))
    leads = total(["comp", "lead"]).select("comp", "lead", _pieces(F.col("n") * 4, F.col("size") * 4).alias("quarters"))
    df = members.join(C.sized(sizes, n_members), "comp").join(C.sized(leads, n_members), ["comp", "lead"])
    bin_ = F.pmod(F.xxhash64("lead", F.lit(3)), F.col("n_blocks") * 2)
    piece = F.xxhash64("lead", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.ceil(F.col("quarters") / 4)))
    part = F.when(F.col("n_blocks") == 1, 0).when(F.col("quarters") == 1, bin_).otherwise(piece)
    return C.materialize(df.select("doc_id", "comp", "n_blocks", F.col("doc_id").alias("class"), part.cast("long").alias("part")), "jaccard-members")


def _against(texts: DataFrame, members: DataFrame, n_members: int, signs: DataFrame, probes: DataFrame, n: int, percent: int) -> DataFrame:
    """The probe documents with the other blocks that they may have a link in.

    These are the blocks in which a document of another class kept a hash that
    the probe kept. A block's probes are dealt into chunks of a block's size, so
    a task holds two blocks at most. ``n_members`` are the rows of ``members``,
    which bound those of every table of documents or blocks.
    """
    classes = C.sized(members.select("doc_id", "class"), n_members)
    now = C.materialize(signs.join(classes, "doc_id"), "jaccard-now")
    span = (F.min("class").alias("low"), F.max("class").alias("high"))
    spread = C.materialize(now.select("comp", "part", "class", F.explode("sigs").alias("sig")).groupBy("sig", "comp", "part").agg(*span), "jaccard-there")
    # a hash that one class alone kept says nothing; the blocks of the others lie in lists of some LISTED each
    mixed = spread.groupBy("sig").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).where("low < high").select("sig", "n")
    piece = F.pmod(F.xxhash64("part"), F.ceil(F.col("n") / LISTED)).alias("piece")
    there = spread.join(C.sized(mixed, spread.count()), "sig").groupBy("sig", piece).agg(F.collect_list(F.struct(F.col("part").alias("to"), "low", "high")).alias("at"))
    there = C.materialize(there, "jaccard-mixed")
    asked = now.join(C.sized(probes, n_members), "doc_id", "left_semi").select("doc_id", "comp", "part", "class", F.explode("sigs").alias("sig"))
    open_ = F.filter("at", lambda x: (x["to"] != F.col("part")) & ((x["low"] != F.col("class")) | (x["high"] != F.col("class"))))
    meets = asked.join(there.hint("merge"), "sig").select("doc_id", "comp", "piece", F.transform(open_, lambda x: x["to"]).alias("to"))
    meets = meets.groupBy("doc_id", "comp", "piece").agg(F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
    meets = meets.select("doc_id", "comp", F.explode("to").alias("part")).distinct()
    meets = C.materialize(meets, "jaccard-meets")
    body = texts.select("doc_id", "comp", "part", "text").join(classes, "doc_id")
    moved = body.select("doc_id", "text", "class").join(C.sized(meets), "doc_id")
    chunks = moved.groupBy("comp", "part").agg(_pieces(F.count("*"), F.sum(F.octet_length("text"))).alias("n_chunks"))
    chunks = C.materialize(chunks, "jaccard-chunks")
    pieces = C.sized(chunks, n_members)
    chunk = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("n_chunks")).cast("int")
    block = F.xxhash64("comp", "part", "chunk").alias("block")
    moved = moved.join(pieces, ["comp", "part"]).withColumn("chunk", chunk)
    held = body.join(pieces, ["comp", "part"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    cols = ["doc_id", "text", "class", block]
    rows = moved.select(*cols, F.lit(True).alias("probe")).unionAll(held.select(*cols, F.lit(False).alias("probe")))
    out = C.materialize(_grouped(rows, n, percent), "jaccard-probe")
    C.release(now, spread, there, meets, chunks)
    return out
