"""Links of markdown pages: where they stand, what they point to, how promising they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.arrays import let, running_sum
from gleanery.functions.text import squeeze

# Fixed values of the scorer.
GENERIC_TITLES = ("United States", "English language", "IMDb", "ISBN", "Wayback Machine", "WorldCat")
LOW_VALUE_ANCHORS = ("he", "she", "it", "they", "this", "that", "here", "there", "website", "official website", "archive", "source")
REFERENCE_MARKERS = ("references", "external links", "further reading", "isbn", "doi:", "retrieved", "archived")
RELATION_HINTS = ("played for", "member of", "born in", "died in", "located in", "based in", "founded", "directed", "written by", "starring", "produced by", "created by", "part of", "known for", "won", "awarded", "married")
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
#: Marks that stay as they are in quoted titles.
SAFE = ":/()_,"
#: Characters of a context on both sides of its link.
AROUND = 180
#: Code points of a text's pieces that contexts are cut from.
PIECE = 1024


def _link_pattern(depth: int) -> str:
    """Groups: what lies before the link, its anchor, its target, and the bracket that closes it."""
    plain = r"[^()\\]++|\\."
    inner = f"(?:{plain})*+"
    for _ in range(depth):
        inner = rf"(?:{plain}|\({inner}\))*+"
    # \G and the possessive parts keep it linear: no second start inside a match or behind the last, no second look at brackets that begin no link
    passed = r"[^\[]++|(?<=!)\[|(?<!!)\[[^\]]*+(?:\](?!\()|\z)"
    return rf"(?s)\G((?:{passed})*+)\[([^\]]*+)\]\((?:({inner})(\))|.*\z)"


def links_in(text: Column, depth: int = 6) -> Column:
    """array<struct<anchor, target, start, stop>> of a markdown text's links, images left out, in their order.

    A target may hold escaped brackets, and balanced ones in ``depth`` levels.
    One that isn't closed takes the rest of the text with it. Places count code
    points from 0.
    """
    pattern = F.lit(_link_pattern(depth))
    whole, before, anchor, target, closed = (F.regexp_extract_all(text, pattern, F.lit(i)) for i in range(5))
    # each match begins where the one before ended, so that lengths give the places
    sizes = F.transform(whole, F.length)
    ends = let(sizes, lambda x: F.arrays_zip(x.alias("size"), running_sum(x).alias("stop")))
    found = F.zip_with(F.arrays_zip(anchor.alias("anchor"), target.alias("target"), closed.alias("closed"), before.alias("before")), ends, lambda x, y: F.struct(x["anchor"].alias("anchor"), x["target"].alias("target"), (y["stop"] - y["size"] + F.length(x["before"])).alias("start"), y["stop"].alias("stop"), x["closed"].alias("closed")))
    return F.transform(F.filter(found, lambda x: x["closed"] != ""), lambda x: F.struct(*(x[c].alias(c) for c in ("anchor", "target", "start", "stop"))))


def _quoted(title: Column) -> Column:
    """Percent-encoded anew; a title that isn't valid percent-encoding is taken as it is."""
    out = let(title, lambda t: F.url_encode(F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)))
    for a, b in [("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in SAFE if c != "_")]:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def article_address(target: Column, source: Column) -> Column:
    """The full address of the encyclopedia article that a link's target names, its title quoted in one way; null for other targets.

    A target without a host is on that of ``source``, the page's own address.
    """

    def parts(s: Column) -> Column:
        told, away = s["told"], s["away"]
        host = F.regexp_extract(F.when(away, told).otherwise(F.coalesce(s["source"], F.lit(""))), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
        path = F.when(away, F.regexp_replace(F.regexp_extract(told, "^https?://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")).otherwise(told)
        return F.struct(away.alias("away"), host.alias("host"), path.alias("path"))

    def address(s: Column) -> Column:
        away, path = s["away"], s["path"]
        host = F.when(~away & (s["host"] == ""), "en.wikipedia.org").otherwise(s["host"])
        title = F.regexp_extract(path, "^/wiki/([^#]*)", 1)
        return F.when(path.startswith("/wiki/") & (~away | s["host"].endswith("wikipedia.org")), F.concat(F.lit("https://"), host, F.lit("/wiki/"), _quoted(title)))

    bare = let(F.regexp_replace(target, r"(?U)^\s+|\s+$", ""), lambda t: F.when(t.rlike("^<[^>]*>"), F.regexp_extract(t, "^<([^>]*)>", 1)).otherwise(F.substring_index(t, " ", 1)))
    marked = let(F.struct(bare.alias("told"), source.alias("source")), lambda s: F.struct(s["told"].alias("told"), s["told"].rlike("^https?://").alias("away"), s["source"].alias("source")))
    return let(let(marked, parts), address)


def page_links(pages: DataFrame, id_col: str, text_col: str, url_col: str) -> DataFrame:
    """id, rank (from 1), anchor, url (null if it is no article), start, stop and context (180 characters on both sides) of each link.

    All is found inside a page's row, so that no link carries the page's text.
    """
    cols = pages.select(pages[id_col].cast("long").alias("id"), pages[text_col].alias("t"), pages[url_col].alias("u"))
    pieces = F.regexp_extract_all("t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def context(l: Column, pieces: Column) -> Column:
        begin, end = F.greatest(l["start"] - AROUND, F.lit(0)), l["stop"] + AROUND
        first = F.floor(begin / PIECE)
        some = F.array_join(F.slice(pieces, (first + 1).cast("int"), (F.floor(end / PIECE) - first + 1).cast("int")), "")
        return squeeze(F.substring(some, (begin - first * PIECE + 1).cast("int"), (end - begin).cast("int")))

    links = let(pieces, lambda ps: F.transform(links_in(F.col("t")), lambda l: F.struct(l["anchor"].alias("anchor"), article_address(l["target"], F.col("u")).alias("url"), l["start"].alias("start"), l["stop"].alias("stop"), context(l, ps).alias("context"))))
    rows = cols.select("id", F.posexplode(links).alias("at", "l"))
    return rows.select("id", (F.col("at") + 1).cast("long").alias("rank"), "l.*")


def named_entity(text: Column) -> Column:
    """Half of the words, one at least, begin with an upper-case letter."""
    upper = lambda ws: F.size(F.filter(ws, lambda w: (F.left(w, F.lit(1)) != F.lower(F.left(w, F.lit(1))))))
    return let(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), lambda ws: (F.size(ws) > 0) & (upper(ws) >= F.greatest(F.lit(1), F.floor(F.size(ws) / 2))))


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def link_score(title: Column, anchor: Column, context: Column, rank: Column) -> Column:
    """struct(score, reasons): 0 with the first ground to leave a link out, else what speaks for it. Marks are found inside words too."""
    names = ("base", "early_link", "middle_link", "named_entity_title", "named_entity_anchor", "relation_context_hint", "specific_multiword_title")
    points = (1.0, 1.0, 0.4, 1.2, 0.4, 1.0, 0.3)

    def judged(s: Column) -> Column:
        t, a, c, rank = s["t"], s["a"], s["c"], s["rank"]
        date = t.rlike(r"^\d{3,4}$") | t.rlike(rf"^({MONTHS})\s+\d{{1,2}}$")
        out = F.when(t.isin(*GENERIC_TITLES), "generic_title").when(date, "year_or_date_title").when(F.lower(a).isin(*LOW_VALUE_ANCHORS) | (F.length(a) < 2), "low_value_anchor").when(_any(c, REFERENCE_MARKERS), "reference_like_context")
        signs = (F.lit(True), rank <= 30, (rank > 30) & (rank <= 100), named_entity(t), (a != t) & named_entity(a), _any(c, RELATION_HINTS), t.rlike(r"\S\s+\S"))
        return F.struct(out.alias("out"), F.array(*signs).alias("signs"))

    def scored(s: Column) -> Column:
        score = F.lit(0.0)
        for i, p in enumerate(points):
            score = score + F.when(s["signs"][i], p).otherwise(0.0)
        reasons = F.filter(F.array(*(F.when(s["signs"][i], F.lit(name)) for i, name in enumerate(names))), lambda x: x.isNotNull())
        left_out = s["out"].isNotNull()
        return F.struct(F.when(left_out, 0.0).otherwise(score).alias("score"), F.when(left_out, F.array(s["out"])).otherwise(reasons).alias("reasons"))

    told = F.struct(F.trim(title).alias("t"), squeeze(anchor).alias("a"), F.lower(context).alias("c"), rank.alias("rank"))
    return let(let(told, judged), scored)
