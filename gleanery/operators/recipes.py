"""Row builders of training recipes and evaluations: conversations collapsed, traces rewritten, answers looked up, open answers parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.arrays import length_budget
from gleanery.functions.text import squeeze
from gleanery.operators.batches import first_filled


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def collapsed(prompt: Column, truths: list[Column], system: str) -> Column:
    """struct(prompt, ground_truth): the system's words first, and the first truth that is filled."""
    return F.struct(F.concat(F.array(message("system", F.lit(system))), prompt).alias("prompt"), first_filled(*truths).alias("ground_truth"))


def completed(prompt: Column, completion: Column, system: str) -> Column:
    """A prompt with the system's words before it and its completion after it."""
    return F.concat(F.array(message("system", F.lit(system))), prompt, F.array(message("assistant", completion)))


def solution_after_marks(text: Column) -> Column:
    """A worked solution's number: what stands after four marks, without thousands separators; null without them."""
    found = F.regexp_extract(text, r"#### (\-?[0-9\.\,]+)", 1)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit(""))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def tool_trace(text: Column) -> Column:
    """Messages of a text in which code, its output and the answer stand in tags: assistant (words and code), tool (output), ..., assistant (answer)."""
    # what a turn says reaches to the end of its code or answer, and what its tool says is between the tags of its output
    said = F.regexp_extract_all(text, F.lit(r"(?s)(.*?(?:</code>|</answer>|\z))(?:\s*<interpreter>(.*?)</interpreter>)?"), F.lit(1))
    told = F.regexp_extract_all(text, F.lit(r"(?s)(.*?(?:</code>|</answer>|\z))(?:\s*<interpreter>(.*?)</interpreter>)?"), F.lit(2))
    pairs = F.zip_with(said, told, lambda a, b: F.array(message("assistant", _stripped(a)), message("tool", _stripped(b))))
    return F.filter(F.flatten(pairs), lambda m: m["content"] != "")


def countdown_question(numbers: Column, target: Column) -> Column:
    return F.concat(F.lit("Reach "), target.cast("string"), F.lit(" with the numbers "), F.array_join(numbers.cast("array<string>"), ", "), F.lit(", each used once at most, and put the calculation between <answer> and </answer>."))


def counted_letters(word: Column, letter: Column) -> Column:
    """A line for each letter of a dashed word, whether it is the one that is counted, and then their number in a box."""
    letters = F.split(word, "-")
    lines = F.transform(letters, lambda c: F.concat(c, F.when(c == letter, " = ").otherwise(" != "), letter, F.lit(".")))
    n = F.size(F.filter(letters, lambda c: c == letter)).cast("string")
    return F.array_join(F.concat(lines, F.array(F.concat(F.lit("\\boxed{"), n, F.lit("} "), letter, F.lit(" in "), word, F.lit(".")))), "\n")


def looked_up_answers(runs: DataFrame, known: DataFrame, id_col: str, answers: str, nested: bool = False) -> DataFrame:
    """Each run's answer: the first of its own (``nested``) or all of them, joined; without any, the one on record; else empty."""
    own = F.get(answers, F.lit(0)) if nested else F.array_join(answers, ", ")
    met = runs.join(known.select(id_col, F.col("answer").alias("_known")).dropDuplicates([id_col]), id_col, "left")
    return met.withColumn("correct_answer", F.when(F.size(F.coalesce(F.col(answers), F.array().cast("array<string>"))) > 0, F.coalesce(own, F.lit(""))).otherwise(F.coalesce("_known", F.lit("")))).drop("_known")


def kept_proofs(verdict: Column, marks: tuple[str, ...] = ("[[1]]",)) -> Column:
    """Whether a recorded verdict holds one of the marks."""
    out = F.lit(False)
    for m in marks:
        out = out | F.coalesce(verdict, F.lit("")).contains(m)
    return out


def research_answer(response: Column) -> Column:
    """What a response answers: without its thoughts, what stands between answer tags, else in the first box, else all of it."""
    text = F.trim(F.regexp_replace(F.trim(F.coalesce(response, F.lit(""))), r"(?is)<think>.*?</think>", ""))
    tag = r"(?is)<answer>(.*?)</answer>"
    tail = F.when(text.contains("boxed{"), F.substring(text, (F.instr(text, "boxed{") + 6).cast("int"), F.length(text)))
    # the text up to the bracket that closes the box: as many have opened as closed before it
    opened = F.transform(F.split(tail, "}"), lambda p, i: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    depth = F.transform(opened, lambda _, i: F.aggregate(F.slice(opened, 1, i + 1), F.lit(1), lambda t, x: t + x) - i)
    closing = F.array_position(F.transform(depth, lambda d: d == 1), True)
    boxed = F.when((closing > 0) & (closing < F.size(opened)), F.trim(F.array_join(F.slice(F.split(tail, "}"), F.lit(1), closing.cast("int")), "}")))
    return F.when(text.rlike(tag), F.trim(F.regexp_extract(text, tag, 1))).otherwise(F.coalesce(boxed, text))


def plain_answer(text: Column) -> Column:
    """Lower-cased, squeezed, without marks at its ends."""
    return F.regexp_replace(squeeze(F.lower(F.coalesce(text, F.lit("")))), r"^[^\w\-]+|[^\w\-]+$", "")


def filled_slots(template: Column, slots: dict[str, Column]) -> Column:
    """A template with each {{name}} replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def expanded_placeholders(text: Column, placeholder: str, token: str, sizes: Column) -> Column:
    """The n-th placeholder as sizes[n] tokens; those beyond the sizes stay."""
    parts = F.split(text, "\\Q" + placeholder + "\\E")
    made = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.repeat(F.lit(token), F.get(sizes, i - 1)), F.lit(placeholder)), p)))
    return F.array_join(made, "")


def resolved_media(rows: DataFrame, media: str, folder: str, there: DataFrame) -> DataFrame:
    """Each name with the folder before it if that file is listed in ``there.path``, else as it is."""
    full = F.concat(F.lit(folder.rstrip("/") + "/"), F.col(media))
    files = there.select(F.col("path").alias("_path")).distinct()
    return rows.join(files, full == F.col("_path"), "left").withColumn("resolved", F.coalesce("_path", media)).drop("_path")


def token_masks(messages: Column, roles: tuple[str, ...] = ("assistant",), last_only: bool = False) -> Column:
    """array<struct<token, trained>>: the white-space tokens of all messages, and whether they are trained on."""
    last = F.size(messages) - 1
    trained = lambda m, i: m["role"].isin(*roles) & (i == last if last_only else F.lit(True))
    parts = F.transform(messages, lambda m, i: F.transform(F.filter(F.split(m["content"], r"\s+"), lambda t: t != ""), lambda t: F.struct(t.alias("token"), trained(m, i).alias("trained"))))
    return F.flatten(parts)


def encoded_turns(turns: Column, budget: int, train_on_prompt: bool = False, mask_history: bool = False, ignore: int = -100) -> Column:
    """struct(input_ids, labels) of turns, an array<struct<source: array<long>, target: array<long>>> of token ids.

    Turns take what is left of the budget, one after the other, shared between
    their sides by :func:`length_budget`; with ``mask_history`` the last turn
    comes first and is the only one trained on. A prompt's labels are ``ignore``
    unless it is trained on.
    """
    blank = lambda c: F.transform(c, lambda _: F.lit(ignore).cast("long"))
    order = F.reverse(turns) if mask_history else turns
    none = F.array().cast("array<bigint>")
    empty = F.struct(F.lit(0).alias("used"), F.array(F.struct(none.alias("ids"), none.alias("labels"))).alias("parts"))

    def take(acc: Column, t: Column) -> Column:
        share = length_budget(F.size(t["source"]), F.size(t["target"]), F.lit(budget) - acc["used"])
        source = F.slice(t["source"], F.lit(1), share["source_len"])
        target = F.slice(t["target"], F.lit(1), share["target_len"])
        learnt = F.when(F.size(acc["parts"]) == 1, target).otherwise(blank(target)) if mask_history else target
        part = F.struct(F.concat(source, target).alias("ids"), F.concat(source if train_on_prompt else blank(source), learnt).alias("labels"))
        more = F.struct((acc["used"] + F.size(source) + F.size(target)).alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))
        return F.when(acc["used"] >= budget, acc).otherwise(more)

    parts = F.aggregate(order, empty, take)["parts"]
    parts = F.reverse(parts) if mask_history else parts
    return F.struct(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("input_ids"), F.flatten(F.transform(parts, lambda p: p["labels"])).alias("labels"))


def paired(chosen: Column, rejected: Column) -> Column:
    """Two rows of a preference: the chosen side first."""
    return F.array(F.struct(F.lit("chosen").alias("side"), chosen.alias("ids")), F.struct(F.lit("rejected").alias("side"), rejected.alias("ids")))


def episode_batch(episodes: DataFrame, steps: str, length: int, pad: int = 0) -> DataFrame:
    """A row for each step of each episode: ids padded to ``length``, the reward on the last token of the last step, and whether the episode ended well enough to be trained on.

    ``steps`` is an array<array<long>> of token ids.
    """
    rows = episodes.select("episode", "reward", "ended", F.size(steps).alias("n_steps"), F.posexplode(steps).alias("step", "ids"))
    rows = rows.withColumn("held", F.least(F.size("ids"), F.lit(length)))
    size, kept = F.col("held"), F.slice("ids", F.lit(1), F.col("held"))
    rewards = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when((i == size) & (F.col("step") == F.col("n_steps") - 1), F.col("reward")).otherwise(0.0))
    return rows.select("episode", "step", F.concat(kept, F.array_repeat(F.lit(pad).cast("long"), F.lit(length) - size)).alias("ids"), rewards.alias("rewards"), F.col("ended").isin("done", "turn_limit").alias("trained"))


def step_of_trace(trace: Column) -> Column:
    """struct(n_messages, output, model) of a recorded call's JSON."""
    t = F.from_json(trace, "struct<input: struct<messages: array<struct<role: string, content: string>>>, output: struct<message: struct<role: string, content: string>>, metadata: map<string, string>>")
    return F.struct((F.size(t["input"]["messages"]) + 1).alias("n_messages"), t["output"]["message"]["content"].alias("output"), F.try_element_at(t["metadata"], F.lit("model")).alias("model"))


def split_neighbours(links: DataFrame, nodes: DataFrame, queued: DataFrame, page: str, url: str, rank: str, most: int) -> DataFrame:
    """The first ``most`` links of each page: ``edge`` to a node that is known, ``attach`` to one that waits, else ``enqueue``."""
    first = links.withColumn("_r", F.row_number().over(Window.partitionBy(page).orderBy(rank, url))).where(F.col("_r") <= most).drop("_r")
    known = nodes.select(url).distinct().withColumn("_known", F.lit(True))
    waits = queued.select(url).distinct().withColumn("_waits", F.lit(True))
    what = F.when(F.col("_known"), "edge").when(F.col("_waits"), "attach").otherwise("enqueue")
    return first.join(known, url, "left").join(waits, url, "left").withColumn("action", what).drop("_known", "_waits")


def grounded_edges(images: DataFrame, nodes: DataFrame, image: str, names: str, label: str) -> DataFrame:
    """A row for each entity that an image is said to show: the node of that label and status ``edge``, or ``unresolved``."""
    said = images.select(image, F.explode(names).alias(label))
    met = said.join(nodes.select(label, "node").dropDuplicates([label]), label, "left")
    return met.select(image, label, "node", F.when(F.col("node").isNull(), "unresolved").otherwise("edge").alias("status"))


def open_answers(response: Column) -> Column:
    """Texts that an open response may answer: of each clause what follows the last sign of an answer, the shortest; else the whole. Without marks alone."""
    # The signs of an answer.
    signs = ("could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result ")
    whole = F.lower(F.regexp_replace(F.trim(response), r"^\.+|\.+$", ""))
    clauses = F.split(whole, "\n")
    last = F.size(clauses) - 1

    def tail(c: Column, i: Column) -> Column:
        found = [F.when(c.contains(s), F.trim(F.substring_index(c, s, -1))) for s in signs] + [F.when(c.contains("=") & (i == last), F.trim(F.substring_index(c, "=", -1)))]
        kept = F.filter(F.array(*found), lambda x: x.isNotNull() & (x != ""))
        least = F.array_min(F.transform(kept, F.length))
        return F.get(F.filter(kept, lambda x: F.length(x) == least), F.lit(0))

    tails = F.filter(F.transform(clauses, tail), lambda x: x.isNotNull() & ~x.isin(":", ",", ".", "!", "?", ";", "'"))
    return F.when(F.size(tails) == 0, F.array(whole)).otherwise(tails)


def numbers_in(text: Column) -> Column:
    """Numbers with thousands separators, in scientific notation, and plain ones, rounded to two places."""
    # The notations.
    forms = (r"-?\b\d{1,3}(?:,\d{3})+\b", r"-?\d+(?:\.\d+)?[eE][+-]?\d+", r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f), F.lit(0)) for f in forms))
    return F.transform(found, lambda x: F.round(F.replace(x, F.lit(","), F.lit("")).try_cast("double"), 2))
