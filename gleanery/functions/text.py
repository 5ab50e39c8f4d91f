"""Functions of texts, HTML and answers, as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.arrays import let

# The patterns of the cleaning steps, in their order, as results must be the same.
SCRIPT = r"(?is)<[ ]*script.*?/[ ]*script[ ]*>"
STYLE = r"(?is)<[ ]*style.*?/[ ]*style[ ]*>"
META = r"(?is)<[ ]*meta.*?>"
COMMENT = r"(?is)<[ ]*!--.*?--[ ]*>"
LINK = r"(?is)<[ ]*link.*?>"
A_OPEN, A_CLOSE = r"(?is)<[ ]*a\b[^>]*>", r"(?is)<[ ]*/[ ]*a[ ]*>"
BASE64_IMG = r"""<img[^>]+src="data:image/[^;]+;base64,[^"]+"[^>]*>"""
IMG_WITH_ALT = r"""(?is)<[ ]*img\b[^>]*?\balt\s*=\s*["']([^"'>]+)["'][^>]*>"""
IMG = r"(?is)<[ ]*img\b[^>]*>"
URL_ATTR = r"""(?is)\s(?:href|src|srcset|action|poster|cite|data-src)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
BARE_URL = r"""(?i)https?://[^\s<>"')]+"""
SVG = r"(?is)(<svg[^>]*>)(.*?)(</svg>)"
# Where a text may be cut, best first.
BREAKS = ("</section>", "</article>", "</p>", "</div>", "</li>", "\n\n", "\n", ". ", " ")
PUNCTUATION = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def _drop(c: Column, *patterns: str) -> Column:
    for p in patterns:
        c = F.regexp_replace(c, p, "")
    return c


def images_to_alt(html: Column) -> Column:
    """Images become their alternative text between spaces, or nothing."""
    return _drop(F.regexp_replace(html, IMG_WITH_ALT, " $1 "), IMG)


def strip_anchors(html: Column) -> Column:
    return _drop(html, A_OPEN, A_CLOSE)


def strip_urls(html: Column) -> Column:
    return _drop(html, URL_ATTR, BARE_URL)


def replace_svg(html: Column, body: str = "this is a placeholder") -> Column:
    return F.regexp_replace(html, SVG, f"$1{body}$3")


def replace_base64_images(html: Column, src: str = "#") -> Column:
    return F.regexp_replace(html, BASE64_IMG, f'<img src="{src}"/>')


def clean_html(html: Column, svg: bool = True, base64: bool = True) -> Column:
    """Scripts, styles, metas, comments, links and anchors go; then embedded images, image texts, URLs and drawings. Embedded images lose their text, as they are rewritten first."""
    c = strip_anchors(_drop(html, SCRIPT, STYLE, META, COMMENT, LINK))
    c = replace_base64_images(c) if base64 else c
    c = strip_urls(images_to_alt(c))
    return replace_svg(c) if svg else c


def strip_html(text: Column) -> Column:
    """Tags become spaces, runs of white space one."""
    return squeeze(F.regexp_replace(text, r"(?s)<[^>]+>", " "))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def rfind(text: Column, needle: str) -> Column:
    """Start (from 0) of the last occurrence of ``needle``; -1 without one."""
    back = F.instr(F.reverse(text), needle[::-1])
    return F.when(back > 0, F.length(text) - back - len(needle) + 1).otherwise(-1)


def truncate_safely(text: Column, most: int, marker: str = "\n[truncated]") -> Column:
    """Cut after the first kind of break, in order of preference, whose last place in the head is at 65 % of ``most`` or later."""
    head = F.substring(text, 1, most)
    least = int(most * 0.65)
    cut = F.coalesce(*(F.when(rfind(head, b) >= least, rfind(head, b) + len(b)) for b in BREAKS), F.lit(most))
    return F.when((F.length(text) <= most) | F.lit(most <= 0), text).otherwise(F.concat(F.rtrim(F.substring(text, F.lit(1), cut)), F.lit(marker)))


def strip_fence(text: Column) -> Column:
    """The inside of one outer markdown fence, if the text is that alone."""
    inner = F.regexp_extract(text, r"(?is)\A\s*```(?:markdown|md)?[^\S\n]*\n(.*?)\n```\s*\z", 1)
    return F.when(text.rlike(r"(?is)\A\s*```(?:markdown|md)?[^\S\n]*\n.*?\n```\s*\z"), F.trim(inner)).otherwise(F.trim(text))


def normalize_url(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url).otherwise(F.concat(F.lit("https://"), url))


def url_extension(url: Column) -> Column:
    """What follows the last dot of the path, in lower case; null without one."""
    path = F.regexp_replace(url, r"[?#].*$", "")
    found = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(found != "", found)


def title_from_url(url: Column) -> Column:
    name = F.regexp_extract(url, r"/([^/?#]*)(?:[?#].*)?$", 1)
    return F.when(name != "", F.replace(name, F.lit("_"), F.lit(" ")))


def first_paragraph(text: Column, most: int = 1000) -> Column:
    blocks = F.filter(F.split(text, r"\n\s*\n"), lambda b: F.trim(b) != "")
    return F.substring(F.trim(F.try_element_at(blocks, F.lit(1))), 1, most)


def entity_label(label: Column) -> Column:
    """Letters, digits and CJK in lower case, the rest as single spaces."""
    return F.trim(F.lower(F.regexp_replace(label, r"[^0-9a-zA-Z\x{4e00}-\x{9fff}]+", " ")))


def predicate(text: Column) -> Column:
    """A relation's name: single spaces, no punctuation around it; 'related to' if nothing is left."""
    out = F.regexp_replace(squeeze(text), r"^[\s.,:;]+|[\s.,:;]+$", "")
    return F.coalesce(F.when(out != "", out), F.lit("related to"))


def clamp(text: Column, low: float, high: float) -> Column:
    """A number within bounds; null where the text is none."""
    return F.greatest(F.least(text.try_cast("double"), F.lit(high)), F.lit(low))


def repetition(text: Column, n: int = 30, threshold: float = 0.5) -> Column:
    """Whether distinct n-character windows are fewer than ``threshold`` of all; short texts aren't."""
    count = F.length(text) - n + 1
    grams = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(count < 1, False).otherwise(F.size(F.array_distinct(grams)) / count < threshold)


def english_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]+(?:['-][A-Za-z]+)*"))


def middle_truncate(text: Column, most: int) -> Column:
    half = most // 2
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(half)), F.lit(" ... "), F.right(text, F.lit(half)))).otherwise(text)


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    c = F.regexp_replace(F.lower(text), PUNCTUATION, "")
    return squeeze(F.regexp_replace(c, r"\b(a|an|the)\b", " "))


def exact_match(answer: Column, gold: Column) -> Column:
    return normalize_answer(answer) == normalize_answer(gold)


def _numbered(tokens: Column) -> Column:
    """Each token with the number of its occurrence: what two lists share as multisets, these share as sets. Equal tokens are one match in the sorted text."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(tokens), " "), F.lit(r"([^ ]++)(?: \1(?![^ ]))*+"), F.lit(0))

    def each(s: Column) -> Column:
        n = (F.length(s["run"]) + 1) / (F.length(s["token"]) + 1)
        return F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: F.concat(s["token"], F.lit(" "), i.cast("string")))

    return F.flatten(F.transform(runs, lambda run: let(F.struct(run.alias("run"), F.substring_index(run, " ", 1).alias("token")), each)))


def normalized_f1(answer: Column, gold: Column) -> Column:
    """``token_f1`` of texts that went through ``normalize_answer``."""

    def counted(s: Column) -> Column:
        return F.struct(s["a"].alias("a"), s["g"].alias("g"), F.size(s["ta"]).cast("double").alias("na"), F.size(s["tg"]).cast("double").alias("ng"), F.size(F.array_intersect(_numbered(s["ta"]), _numbered(s["tg"]))).cast("double").alias("same"))

    def scored(s: Column) -> Column:
        a, g = s["a"], s["g"]
        closed = (a.isin("yes", "no", "noanswer") | g.isin("yes", "no", "noanswer")) & (a != g)
        p, r = s["same"] / s["na"], s["same"] / s["ng"]
        return F.when(a.isNull() | g.isNull() | closed, 0.0).when(s["same"] == 0, 0.0).otherwise(2 * p * r / (p + r))

    tokens = lambda text: F.filter(F.split(text, " "), lambda t: t != "")
    texts = let(F.struct(answer.alias("a"), gold.alias("g")), lambda s: F.struct(s["a"].alias("a"), s["g"].alias("g"), tokens(s["a"]).alias("ta"), tokens(s["g"]).alias("tg")))
    return let(let(texts, counted), scored)


def token_f1(answer: Column, gold: Column) -> Column:
    """F1 of the tokens' multisets, 0 without tokens or text; yes, no and noanswer only match themselves."""
    return normalized_f1(normalize_answer(answer), normalize_answer(gold))


def between(text: Column, tag: str) -> Column:
    """What stands between the first opening tag and the closing tag after it; null without both."""
    p = rf"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, 1)))


def action(text: Column) -> Column:
    """struct(kind, content) of a model's turn: a tool call, else a final answer, else reasoning."""
    return F.coalesce(
        F.when(between(text, "tool_call").isNotNull(), F.struct(F.lit("tool_call").alias("kind"), between(text, "tool_call").alias("content"))),
        F.when(between(text, "response").isNotNull(), F.struct(F.lit("final_answer").alias("kind"), between(text, "response").alias("content"))),
        F.when(between(text, "answer").isNotNull(), F.struct(F.lit("final_answer").alias("kind"), between(text, "answer").alias("content"))),
        F.struct(F.lit("reasoning").alias("kind"), text.alias("content")),
    )


def valid_format(text: Column) -> Column:
    """A thought and then exactly one call, response or answer."""
    return F.coalesce(text.rlike(r"(?s)\A<think>.*?</think>\s*(<tool_call>.*?</tool_call>|<response>.*?</response>|<answer>.*?</answer>)\s*\z"), F.lit(False))


def boxed(text: Column) -> Column:
    """Content of the first ``\\boxed{...}``, by a fold over its characters that counts braces; null without one."""
    start = F.instr(text, "\\boxed{")
    rest = F.substring(text, start + 7, F.length(text))
    chars = F.split(rest, "")
    begin = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), (a["n"] + 1).alias("n")))

    size = F.aggregate(chars, begin, step, lambda a: a["n"] - 1)
    inner = F.trim(F.substring(rest, F.lit(1), size))
    inner = F.regexp_replace(inner, r"\\text\{([^}]*)\}", "$1")
    return F.when(start > 0, F.replace(F.replace(inner, F.lit("\\#"), F.lit("#")), F.lit("\\%"), F.lit("%")))


def final_answer(text: Column, most: int = 2000) -> Column:
    """Boxed content, else the answer tag's, the response tag's, what follows the last thought without its calls, the end of the text."""
    after = F.when(F.instr(text, "</think>") > 0, F.trim(_drop(F.substring_index(text, "</think>", -1), r"(?s)<tool_call>.*?</tool_call>")))
    tail = F.right(text, F.lit(most))
    box = boxed(text)
    return F.coalesce(F.when(box != "", box), between(text, "answer"), between(text, "response"), F.when(after != "", F.left(after, F.lit(most))), tail, F.lit(""))


def verdict(raw: Column) -> Column:
    """1 where a judge said ``correct: yes``, else 0."""
    return F.when(F.lower(F.regexp_extract(raw, r"(?i)correct:\s*(yes|no)", 1)) == "yes", 1).otherwise(0)


def last_code_block(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s)```(?:\w+)?\n(.*?)```"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(-1)))


def gsm_answer(text: Column, strict: bool = True) -> Column:
    """The number after the last ``#### `` of the last 300 characters (strict), or the last number there."""
    tail = F.right(text, F.lit(300))
    pattern = r"#### (\-?[0-9\.\,]+)" if strict else r"(\-?[0-9\.\,]+)"
    found = F.regexp_extract_all(tail, F.lit(pattern), F.lit(1))
    found = found if strict else F.filter(found, lambda x: ~x.isin("", "."))
    return F.replace(F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")), F.lit("$"), F.lit(""))


def image_kind(data: Column) -> Column:
    """png, jpg, gif, webp or bmp by the first bytes; png if none fits."""
    head = F.hex(F.substring(data, 1, 12))
    return F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpg").when(head.startswith("47494638"), "gif").when(head.startswith("52494646") & head.endswith("57454250"), "webp").when(head.startswith("424D"), "bmp").otherwise("png")


def anls(answer: Column, golds: Column, threshold: float = 0.5) -> Column:
    """Largest 1 - normalised edit distance to a gold answer, 0 where the distance is ``threshold`` or more."""
    norm = lambda x: F.lower(squeeze(x))

    def one(g: Column) -> Column:
        longest = F.greatest(F.length(norm(answer)), F.length(norm(g)))
        d = F.when(longest == 0, 0.0).otherwise(F.levenshtein(norm(answer), norm(g)) / longest)
        return F.when(d < threshold, 1 - d).otherwise(0.0)

    return F.array_max(F.transform(golds, one))


def relaxed_match(answer: Column, gold: Column, strict: bool = False) -> Column:
    """Numbers within 5 % of the gold one, other texts equal. Negative golds match nothing, as their bounds are swapped; ``strict`` orders the bounds."""
    a, g = F.rtrim(answer, F.lit("%")), F.rtrim(gold, F.lit("%"))
    na, ng = a.try_cast("double"), g.try_cast("double")
    low, high = (F.least(ng * 0.95, ng * 1.05), F.greatest(ng * 0.95, ng * 1.05)) if strict else (ng * 0.95, ng * 1.05)
    return F.when(na.isNotNull() & ng.isNotNull(), na.between(low, high)).otherwise(a == g).cast("double")


def vote_match(answer: Column, golds: Column) -> Column:
    return F.least(F.lit(1.0), F.size(F.filter(golds, lambda g: g == answer)) / 3.0)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 16 hexadecimal digits of the digest of all parts; null counts as empty."""
    joined = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(joined, 256), 1, 16))
