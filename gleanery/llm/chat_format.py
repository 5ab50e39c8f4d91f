"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log row is an event of a conversation: seq orders it, turn says which message
it is about, and event is one of

    message     a message of its own at this turn
    delta       text that goes on the end of the turn's last message
    edit        the turn's messages become this one
    regenerate  as edit, and later turns that were logged before it are dropped

Rows are partitioned by conversation and range of turns; each turn's events,
sorted by sequence, are folded into its final messages, and each range is
rendered. The ranges' texts then meet in one row per conversation. So a very
long conversation is folded by many tasks, and what its last task holds is its
output.

Template. A message is rendered as

    <turn ROLE>\\nTEXT</turn>\\n

Inside roles and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>``
becomes ``\\g``, so a bracket in the output always is a control string, and the
reverse replacements give the text back. The loss mask has a span (start in
code points of its block, length) for each message of an assistant.

Defined results: null texts and roles count as empty; rows of equal turn and
sequence are ordered by role and text; repeated rows are repeated messages; a
delta without a message begins one; events of no known name count as messages;
null turns come first; rows of a null conversation form one conversation; an
empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns that one range holds.
RANGE = 64
LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(text: Column) -> Column:
    for a, b in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold(events: DataFrame, has_regenerations: bool = True) -> DataFrame:
    """conv_id, block, turn and messages array<struct<role, text>> of each turn: its events folded.

    ``events`` has conv_id, seq, turn, event, role and text.
    """
    df = events.select("conv_id", "seq", "turn", F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("block", F.floor(F.col("turn") / RANGE))
    if has_regenerations:
        # a turn's events before a regeneration of an earlier turn are void: of those in earlier ranges, one number a range says it
        again = F.max(F.when(F.col("event") == "regenerate", F.col("seq")))
        earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ranges = df.groupBy("conv_id", "block").agg(again.alias("cut")).select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.max("cut").over(earlier).alias("before"))
        df = df.join(ranges, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("block").eqNullSafe(F.col("_b")), "left").drop("_c", "_b")
        lower = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("cut", F.greatest("before", again.over(lower))).where("cut is null or seq >= cut").drop("before", "cut")
    else:
        # dealt by range once; the aggregation by turn needs no other exchange
        df = df.repartition(F.col("conv_id"), F.col("block"))
    turns = df.groupBy("conv_id", "block", "turn").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "event"))).alias("log"))
    # of a turn's events those from its last edit on; each but a delta begins a message, which goes on to the next beginning
    resets = F.transform("log", lambda e, i: F.when(e["event"].isin("edit", "regenerate"), i + 1).otherwise(1))
    turns = turns.withColumn("log", F.slice("log", F.array_max(resets), F.size("log")))
    begins = F.filter(F.transform("log", lambda e, i: F.when((i == 0) | (e["event"] != "delta"), i + 1)), lambda i: i.isNotNull())
    turns = turns.withColumn("begins", begins)

    def message(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("log") + 1)
        return F.struct(F.get("log", at - 1)["role"].alias("role"), F.array_join(F.transform(F.slice("log", at, end - at), lambda e: e["text"]), "").alias("text"))

    return turns.select("conv_id", "block", "turn", F.transform("begins", message).alias("messages"))


def render(turns: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, n_turns and blocks array<struct<block, text, spans array<struct<start, length>>>> of each conversation."""
    ordered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "messages"))), lambda t: t["messages"]))
    blocks = turns.groupBy("conv_id", "block").agg(ordered.alias("messages"))
    part = F.transform("messages", lambda m: F.struct(F.concat(F.lit("<turn "), escape(m["role"]), F.lit(">\n")).alias("head"), escape(m["text"]).alias("body"), m["role"].isin(*loss_roles).alias("loss")))
    blocks = blocks.select("conv_id", "block", part.alias("parts"))
    tail = "</turn>\n"
    lengths = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(tail))
    blocks = blocks.withColumn("lengths", lengths)
    # at most RANGE turns: sums of prefixes stay small
    spans = F.transform("parts", lambda p, i: F.struct((F.aggregate(F.slice("lengths", F.lit(1), i), F.lit(0), lambda a, x: a + x) + F.length(p["head"]) + 1).alias("start"), F.length(p["body"]).alias("length"), p["loss"].alias("loss")))
    spans = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    blocks = blocks.select("conv_id", F.struct("block", text.alias("text"), spans.alias("spans")).alias("b"), F.size("parts").alias("n"))
    return blocks.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.array_sort(F.collect_list("b")).alias("blocks"))


def format_chats(events: DataFrame, has_regenerations: bool = True, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """conv_id, n_turns, blocks and formatted (their texts, one after the other) of each conversation in a log."""
    out = render(fold(events, has_regenerations), loss_roles)
    return out.withColumn("formatted", F.array_join(F.transform("blocks", lambda b: b["text"]), ""))


def masked_text(blocks: Column) -> Column:
    """All text under the loss mask, read from the blocks and unescaped."""
    cut = F.transform(blocks, lambda b: F.array_join(F.transform(b["spans"], lambda s: F.substring(b["text"], s["start"], s["length"])), ""))
    return unescape(F.array_join(cut, ""))


def parse(formatted: Column) -> Column:
    """The messages of a formatted conversation: array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, "</turn>\n"), lambda t: t != "")

    def one(t: Column) -> Column:
        end = F.instr(t, ">")
        return F.struct(unescape(F.substring(t, F.lit(7), end - 7)).alias("role"), unescape(F.substring(t, end + 2, F.length(t))).alias("text"))

    return F.transform(turns, one)
