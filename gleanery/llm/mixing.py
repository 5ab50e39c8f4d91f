"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks, in DataFrame operations only.

1. A document's size is its number of words. Sources, in code-point order with
   null last, get the weights in turn; together they take ``share`` of all
   sizes, and a source at most ``repeats`` times its own, the excess going to
   the others by weight.
2. Slot n of the schedule is the golden-ratio point frac(n * phi). The point
   falls into one source's interval of the cumulative target shares, and the
   slot's rank among that source's slots names the block that it takes. Any run
   of slots so holds each source nearly in its share.
3. A source's documents, shuffled by a seeded hash, form one stream of words.
   Its target is cut into as many equal blocks as it has slots, round and round
   the stream, so that a second pass begins only when the first is over.
4. Blocks and the document pieces in them meet by an equi-join on (source,
   block).

Prefix sums run in two levels (a hash range of each source, then its totals), so
a source that holds a third of all rows is spread over many tasks. Slots are
ranked in the same way. Reruns agree: nothing depends on partitions or time.

Defined results: a null text has size 0 and is taken 0 words; a null source is
a source, the last one; a null id is kept and ordered by the rest of its row;
repeated rows are documents of their own (rows of equal id and text share their
place in the order and take pieces by it); a source of size 0 has target 0; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import common as C

WEIGHTS = (5, 2, 1)
#: 2 ** 32 divided by the golden ratio.
GOLDEN = 2654435769
WORD = r"[^\x20\x09-\x0D]+"
#: Intervals of the unit line by which points and sources are joined.
GRID = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), repeats: int = 2) -> DataFrame:
    """Source sizes (source, source_size: a row each) with weight, target and the bounds of the cumulative target shares.

    A source is capped if its fair part of what the sources with lower
    size-to-weight ratio leave is above its cap. One row per source, so the
    windows here see as many rows as there are sources.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tight = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    below = tight.rowsBetween(Window.unboundedPreceding, -1)
    rest = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # twice all amounts, so that a share of 3/2 stays a whole number
    whole = F.sum("source_size").over(every) * share[0]
    left = whole - share[1] * F.coalesce(F.sum("cap").over(below), F.lit(0))
    df = df.withColumn("capped", left * F.col("weight") >= share[1] * F.col("cap") * F.sum("weight").over(rest))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    open_ = F.col("whole") - share[1] * F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0))
    df = df.withColumn("whole", whole)
    fair = open_.cast("double") * F.col("weight") / (F.lit(share[1]) * free)
    df = df.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(fair))
    order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(every)
    df = df.withColumn("take", F.floor("target").cast("long")).withColumn("high", F.when(total > 0, F.sum("target").over(order) / total).otherwise(0.0))
    return df.withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy(F.col("source").isNull(), "source")), F.lit(0.0))).select("source", "source_size", "weight", "target", "take", "low", "high")


def schedule(plan: DataFrame, n_slots: int) -> DataFrame:
    """slot, source, rank (of the slot among its source's), of n_slots golden-ratio points and one slot more for each source that none fell to."""
    spark = plan.sparkSession
    point = (F.col("slot") * F.lit(GOLDEN)).bitwiseAND(F.lit((1 << 32) - 1)) / F.lit(float(1 << 32))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.floor(F.col("point") * GRID))
    cells = plan.where("take > 0").select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1)))).alias("cell"))
    last = F.max("high").over(Window.partitionBy("cell"))
    cells = cells.withColumn("high", F.when((F.col("cell") == GRID - 1) & (F.col("high") == last), 2.0).otherwise(F.col("high")))
    fell = slots.join(cells, "cell").where("point >= low and point < high").select("slot", "source")
    hit = fell.select(F.col("source").alias("_s")).distinct()
    missed = plan.where("take > 0").join(hit, F.col("source").eqNullSafe(F.col("_s")), "left_anti").select(F.lit(n_slots).cast("long").alias("slot"), "source")
    dealt = fell.unionAll(missed).withColumn("chunk", F.floor(F.col("slot") / 4096)).withColumn("one", F.lit(1))
    return C.prefix_sums(dealt, ["source"], "chunk", ["slot"], "one", "rank").select("slot", "source", "rank")


def mix(docs: DataFrame, n_slots: int | None = None, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The documents with their sizes and targets, and the mix: (slot, source, rank, doc_id, h, start, words), the pieces of documents in the order of slots.

    ``n_slots`` is 64 for each thousand of documents by default, at least 4096
    and at most 2 ** 26. A document's piece is ``words`` words from word
    ``start`` on; ``h`` and doc_id name the document.
    """
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    # the shuffle's order: the first 60 bits of a digest of seed and id; written once, as three passes need it
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "doc_id")), 1, 15), 16, 10).cast("long")
    base = C.materialize(base.withColumn("h", h), "mix-sizes")
    n = base.count()
    n_slots = n_slots or min(1 << 26, max(4096, n * 64 // 1000))
    n_buckets = max(64, n // 4000)
    plan = C.materialize(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-plan")
    order = C.materialize(schedule(plan, n_slots), "mix-schedule")
    counts = order.groupBy("source").agg(F.count("*").alias("n_blocks"))
    plan = plan.join(counts.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    plan = plan.withColumn("n_blocks", F.coalesce("n_blocks", F.lit(0))).withColumn("block_words", F.greatest(F.ceil(F.col("take") / F.greatest("n_blocks", F.lit(1))), F.lit(1)).cast("long"))
    plan = C.materialize(plan, "mix-blocks")

    # the place of each document in its source's shuffled stream; h is spread evenly, so its high bits make even buckets
    bucket = F.floor(F.col("h") / float(1 << 60) * n_buckets).cast("int")
    placed = C.prefix_sums(base.withColumn("bucket", bucket), ["source"], "bucket", ["h", "doc_id"], "size", "at")
    placed = placed.join(plan.select(F.col("source").alias("_s"), "source_size", "target", "take", "block_words"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "bucket")
    placed = C.materialize(placed, "mix-placed")

    # a document stands once in each pass over the stream that its source's target reaches
    turn = F.explode(F.filter(F.sequence(F.lit(0), F.ceil(F.col("take") / F.greatest("source_size", F.lit(1))).cast("int")), lambda e: F.col("at") + e * F.col("source_size") < F.col("take")))
    pieces = placed.where("size > 0 and take > 0").select("doc_id", "h", "source", "size", "take", "block_words", F.col("at"), "source_size", turn.alias("turn"))
    pieces = pieces.withColumn("from", F.col("at") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), "take"))
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("from") / F.col("block_words")), F.floor((F.col("to") - 1) / F.col("block_words")))))
    begin = F.greatest("from", F.col("rank") * F.col("block_words"))
    end = F.least("to", (F.col("rank") + 1) * F.col("block_words"))
    pieces = pieces.select("doc_id", "h", "source", "rank", (begin - F.col("from")).alias("start"), (end - begin).alias("words"))
    slots = order.select("slot", F.col("source").alias("_s"), F.col("rank").alias("_r"))
    mixed = pieces.join(slots, F.col("source").eqNullSafe(F.col("_s")) & (F.col("rank") == F.col("_r"))).drop("_s", "_r")
    return placed, mixed


def taken(docs: DataFrame, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: what the mix takes of each document."""
    placed, mixed = mix(docs, **options)
    sums = mixed.groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.sum("words").alias("taken"))
    alike = placed.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    out = placed.join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").drop("_d", "_h")
    out = out.withColumn("taken", F.coalesce("taken", F.lit(0)))
    if not alike.isEmpty():  # rows of equal id and size share what was taken of them together
        same = Window.partitionBy("doc_id", "h").orderBy("at")
        nth, rows = F.row_number().over(same), F.count("*").over(Window.partitionBy("doc_id", "h"))
        out = out.withColumn("taken", F.floor(F.col("taken") / rows) + F.when(nth <= F.col("taken") % rows, 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", "taken", *keep)
