"""Operators of conversations held as arrays of (role, content) messages: alignment, checks, rendering, steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ODD, EVEN = ("user", "observation"), ("assistant", "function")
MESSAGES = "array<struct<role: string, content: string>>"
TOOL_GAP = "\n</tool_response>\n<tool_response>\n"
CONVERTERS: dict[str, Callable] = {}


def converter(name: str) -> Callable[[Callable], Callable]:
    """Register a converter; a name that is taken is an error."""

    def keep(fn: Callable) -> Callable:
        if name in CONVERTERS:
            raise ValueError(f"converter {name} is registered twice")
        CONVERTERS[name] = fn
        return fn

    return keep


def message(role, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def gather(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in order of turns."""
    log = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return rows.groupBy(key).agg(F.transform(log, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _aligned(prompt: Column, response: Column, system: Column, tools: Column | None = None) -> Column:
    none = F.lit(None).cast("array<string>")
    return F.struct(prompt.alias("_prompt"), response.alias("_response"), F.coalesce(system, F.lit("")).alias("_system"), F.coalesce(tools if tools is not None else F.lit(""), F.lit("")).alias("_tools"), none.alias("_images"), none.alias("_videos"), none.alias("_audios"))


@converter("instruction")
def from_instruction(prompt: Column, query: Column, response: Column | None, history: Column | None = None, system: Column | None = None, desirable: Column | None = None, chosen: Column | None = None, rejected: Column | None = None) -> Column:
    """Aligned row of an instruction record. ``history`` has (prompt, response) pairs; ``desirable`` makes a feedback row, ``chosen`` and ``rejected`` a preference row."""
    parts = F.filter(F.array(prompt, query), lambda x: x.isNotNull() & (x != ""))
    turns = F.array(message("user", F.array_join(parts, "\n")))
    if history is not None:
        past = F.flatten(F.transform(history, lambda h: F.array(message("user", h[0]), message("assistant", h[1]))))
        turns = F.concat(F.coalesce(past, F.array().cast(MESSAGES)), turns)
    one = lambda c: F.array(message("assistant", c))
    out = F.when(response.isNotNull(), one(response)).otherwise(F.array().cast(MESSAGES)) if response is not None else F.array().cast(MESSAGES)
    if chosen is not None and rejected is not None:
        out = F.when(chosen.isNotNull() & rejected.isNotNull(), F.concat(one(chosen), one(rejected))).otherwise(out)
    if desirable is not None:
        blank = one(F.lit(""))
        out = F.when(desirable.isNull(), out).when(desirable, F.concat(one(response), blank)).otherwise(F.concat(blank, one(response)))
    return _aligned(turns, out, system if system is not None else F.lit(""))


def alternates(messages: Column, odd: tuple[str, ...] = ODD, even: tuple[str, ...] = EVEN) -> Column:
    """Whether roles alternate between the two sets, beginning with the first."""
    return F.forall(F.transform(messages, lambda m, i: F.coalesce(F.when(i % 2 == 0, m["role"].isin(*odd)).otherwise(m["role"].isin(*even)), F.lit(False))), lambda ok: ok)


@converter("turns")
def from_turns(messages: Column, system: Column | None = None, ranking: bool = False) -> Column:
    """Aligned row of a list of turns: a leading system turn is taken off, the last turn is the response; rows whose roles don't alternate or don't pair up become empty."""
    first = F.get(messages, F.lit(0))
    leads = F.coalesce(first["role"] == "system", F.lit(False))
    body = F.when(leads, F.slice(messages, F.lit(2), F.size(messages))).otherwise(messages)
    n = F.size(body)
    fine = alternates(body) & (n % 2 == (1 if ranking else 0))
    empty = F.array().cast(MESSAGES)
    prompt = F.when(fine & (n > 0), body if ranking else F.slice(body, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(empty)
    response = F.when(fine & (n > 0), F.slice(body, n, F.lit(1))).otherwise(empty) if not ranking else empty
    return _aligned(prompt, response, F.when(leads, first["content"]).otherwise(system if system is not None else F.lit("")))


@converter("tool_turns")
def from_tool_turns(messages: Column, observation: str = "observation") -> Column:
    """As turns, after runs of tool results have become one message each; a run at the end goes."""
    return from_turns(merge_observations(messages, observation))


def merge_observations(messages: Column, observation: str = "observation") -> Column:
    """Consecutive tool results joined into one message, by a fold that holds the open run; results at the end are dropped."""
    start = F.struct(F.array().cast(MESSAGES).alias("out"), F.array().cast("array<string>").alias("run"))

    def step(a: Column, m: Column) -> Column:
        closed = F.when(F.size(a["run"]) > 0, F.concat(a["out"], F.array(message(observation, F.array_join(a["run"], TOOL_GAP))))).otherwise(a["out"])
        more = F.struct(a["out"].alias("out"), F.concat(a["run"], F.array(m["content"])).alias("run"))
        return F.when(m["role"] == observation, more).otherwise(F.struct(F.concat(closed, F.array(m)).alias("out"), F.array().cast("array<string>").alias("run")))

    return F.aggregate(messages, start, step, lambda a: a["out"])


def weighted(messages: Column) -> Column:
    """Messages with typed content parts and the weight of their loss: 1 for the assistant's."""
    part = lambda c: F.array(F.struct(F.lit("text").alias("type"), c.alias("value")))
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), part(m["content"]).alias("content"), F.when(m["role"] == "assistant", 1.0).otherwise(0.0).alias("loss_weight")))


def trainable(prompt: Column, response: Column, pairwise: bool = False) -> Column:
    """An odd prompt and one response; two responses or more for pairs."""
    return (F.size(prompt) % 2 == 1) & (F.size(response) >= 2 if pairwise else F.size(response) == 1)


def placeholders(messages: Column, token: str) -> Column:
    """How often ``token`` stands in all messages."""
    return F.aggregate(messages, F.lit(0), lambda a, m: a + ((F.length(m["content"]) - F.length(F.replace(m["content"], F.lit(token), F.lit("")))) / len(token)).cast("int"))


@dataclass(frozen=True)
class Template:
    """Strings around messages by role; ``{{content}}`` stands for the text."""

    user: str
    assistant: str
    system: str = "{{content}}"
    observation: str = "{{content}}"
    prefix: str = ""

    def slot(self, role: Column, content: Column) -> Column:
        fill = lambda s: F.replace(F.lit(s), F.lit("{{content}}"), content)
        return F.when(role == "user", fill(self.user)).when(role == "assistant", fill(self.assistant)).when(role == "system", fill(self.system)).otherwise(fill(self.observation))

    def render(self, messages: Column) -> Column:
        return F.concat(F.lit(self.prefix), F.array_join(F.transform(messages, lambda m: self.slot(m["role"], m["content"])), ""))


CHATML = Template(*(f"<|im_start|>{r}\n{{{{content}}}}<|im_end|>\n" for r in ("user", "assistant", "system", "tool")))


def tool_calls(text: Column, opening: str = "<tool_call>", closing: str = "</tool_call>") -> Column:
    """name and arguments (JSON) of each call between markers; calls that aren't JSON with a name are left out."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)\Q{opening}\E\s*(.*?)\s*\Q{closing}\E"), F.lit(1))
    calls = F.transform(found, lambda c: F.struct(F.get_json_object(c, "$.name").alias("name"), F.get_json_object(c, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull())


def action_calls(text: Column) -> Column:
    """Calls written as ``Action:`` and ``Action Input:`` lines."""
    p = r"(?s)Action:\s*([a-zA-Z0-9_]+)\s*Action Input:\s*(.+?)(?=\s*Action:|\s*\z)"
    names, inputs = F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.regexp_extract_all(text, F.lit(p), F.lit(2))
    return F.transform(F.arrays_zip(names.alias("name"), inputs.alias("arguments")), lambda c: F.struct(c["name"].alias("name"), F.trim(c["arguments"]).alias("arguments")))


def next_observation(rows: DataFrame, key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``observation``: the next row's text if it is the user's and holds a tool response, else empty."""
    w = Window.partitionBy(key).orderBy(turn)
    text, role = F.lead("text").over(w), F.lead("role").over(w)
    return rows.withColumn("observation", F.when((role == "user") & text.contains("<tool_response>"), text).otherwise(""))


def steps(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per assistant message with the messages before it."""
    m = conversations.select(key, "messages", F.posexplode("messages").alias("pos", "m")).where("m.role = 'assistant'")
    w = Window.partitionBy(key).orderBy("pos")
    return m.select(key, (F.row_number().over(w) - 1).alias("step"), F.slice("messages", F.lit(1), F.col("pos")).alias("context"), F.col("m.content").alias("response"))


def cumulative(step_rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Whether each step's context begins with the one before."""
    w = Window.partitionBy(key).orderBy("step")
    before = F.lag("context").over(w)
    fits = before.isNull() | ((F.size("context") >= F.size(before)) & (F.slice("context", F.lit(1), F.size(before)) == before))
    return step_rows.withColumn("_f", fits).groupBy(key).agg(F.bool_and("_f").alias("is_cumulative"))


def mismatched(rows: DataFrame, batch: str, order: str, response: str) -> DataFrame:
    """``kl_response``: each row's response taken from the row before in its batch, the first from the last."""
    w = Window.partitionBy(batch).orderBy(order)
    last = F.last(response).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("kl_response", F.coalesce(F.lag(response).over(w), last))


def role_parts(messages: Column, names: dict[str, str]) -> Column:
    """Messages with roles renamed and contents as typed parts."""
    rename = lambda r: F.coalesce(*(F.when(r == a, b) for a, b in names.items()), r)
    return F.transform(messages, lambda m: F.struct(rename(m["role"]).alias("role"), F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text"))).alias("content")))
