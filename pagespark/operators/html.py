"""Words, paragraphs and links of web pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements whose text is not page text.
SKIPPED = ("script", "noscript", "style", "title", "head", "iframe")
# Form elements that lose the text in them.
EMPTIED = ("option", "input", "textarea")
# Elements that are paragraphs, first choice and second choice.
PARAGRAPH_TAGS = (
    ("li", "td", "tr", "th", "h1", "h2", "h3", "h4", "h5", "h6", "h7", "pre", "dt", "dd", "p"),
    ("p", "dl"),
)
# Characters that part words.
BLANKS = "\u0020\u00a0\t\n\r\u2003\u2002"
# Elements that have no end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Named entities the fast form decodes, the ampersand last.
ENTITIES = {"&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_text(html: Column) -> Column:
    """Page text: skipped elements, text in form elements, comments and tags become blanks."""
    out = html
    for tag in SKIPPED:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    for tag in (t for t in EMPTIED if t not in VOID_TAGS):  # they hold text alone, and may lack an end tag
        out = F.regexp_replace(out, rf"(?i)<{tag}\b[^>]*>[^<]*", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return decoded(out)


def html_words(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Words of each page in order (``pos``), all in expressions."""
    words = F.filter(F.split(html_text(F.col(html)), "[ \\x{00A0}\\t\\n\\r\\x{2002}\\x{2003}]+"), lambda w: w != "")
    return (
        pages.select(page, F.posexplode(words).alias("pos", "word"))
        .select(page, F.col("pos").cast("bigint").alias("pos"), "word")
    )


# Pieces of a page's source: comments, script and style with their content, end tags, start tags (a quoted
# value may hold ">"), declarations, text. A "<" that opens none of these is a text of its own.
PIECES = (
    "<!--.*?-->", r"<script\b[^>]*>.*?</script\s*>", r"<style\b[^>]*>.*?</style\s*>", "</[a-z][^>]*>",
    """<[a-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>""", "<[!?/][^>]*>", "[^<]+", "<",
)
PIECE = "(?is)" + "|".join(PIECES)
NAME = r"^</?([A-Za-z][^\s/>]*)"
RAW_END = r"(?is)^<(?:script|style)\b.*</(?:script|style)\s*>$"
BLANK_RUN = "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in BLANKS) + "]+"
FOLD_PIECES = 256  # folded together; what they give is joined to the rest once

_STACK = "array<struct<id:int,tag:string>>"
_FOUND = "array<struct<piece:int,node:int,pos:bigint,tag:string,paragraph:int,paragraph_tag:string>>"


def decoded(text: Column) -> Column:
    """Text with the named entities of ENTITIES as characters."""
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def text_words(text: Column) -> Column:
    return F.filter(F.split(decoded(text), BLANK_RUN), lambda w: w != "")


def _last_of(stack: Column, *choices: Sequence[str]) -> Column:
    """The innermost open element of the first choice that has one, else the innermost of all."""
    inner = F.reverse(stack)

    def first(choice: Sequence[str]) -> Column:
        return F.get(F.filter(inner, lambda e: e["tag"].isin(*choice)), 0)

    return F.coalesce(*[first(c) for c in choices], F.get(inner, 0))


def _piece_kinds(pieces: Column) -> Column:
    """kind (text, start, end, whole, other), name and number of words of each piece; ``whole`` is an element without content."""

    def one(piece: Column, i: Column) -> Column:
        name = F.lower(F.regexp_extract(piece, NAME, 1))
        tag = piece.startswith("<") & (piece != "<")
        kind = (
            F.when(~tag, "text").when(name == "", "other").when(piece.startswith("</"), "end")
            .when(name.isin(*sorted(VOID_TAGS)), "other").when(piece.endswith("/>") | piece.rlike(RAW_END), "whole").otherwise("start"))
        words = F.when(~tag, F.size(text_words(piece))).otherwise(0)
        return F.struct(kind.alias("kind"), name.alias("name"), words.alias("words"), i.alias("piece"))

    return F.transform(pieces, one)


def _fold(kinds: Column) -> Column:
    """Text pieces with words outside hidden elements, each with its place, element and paragraph.

    The fold keeps the open elements. An end tag closes up to the innermost element of its name and
    does nothing where none is open."""

    def state(stack: Column, seen: Column, node: Column, pos: Column, found: Column) -> Column:
        return F.struct(stack.cast(_STACK).alias("stack"), seen.cast("int").alias("seen"), node.cast("int").alias("node"),
                        pos.cast("bigint").alias("pos"), found.cast(_FOUND).alias("found"))

    def step(s: Column, p: Column) -> Column:
        stack, kind = s["stack"], p["kind"]
        depth = F.array_position(F.reverse(F.transform(stack, lambda e: e["tag"])), p["name"])
        closed = F.slice(stack, F.lit(1), F.size(stack) - depth.cast("int"))
        opened = F.concat(stack, F.array(F.struct((s["seen"] + 1).alias("id"), p["name"].alias("tag"))))
        shown = (kind == "text") & (p["words"] > 0) & ~F.exists(stack, lambda e: e["tag"].isin(*SKIPPED, *EMPTIED))
        paragraph = _last_of(stack, *PARAGRAPH_TAGS)
        new = F.struct(p["piece"].cast("int").alias("piece"), s["node"].alias("node"), s["pos"].alias("pos"), F.get(stack, F.size(stack) - 1)["tag"].alias("tag"),
                       paragraph["id"].alias("paragraph"), paragraph["tag"].alias("paragraph_tag"))
        return state(
            F.when(kind == "start", opened).when((kind == "end") & (depth > 0) & (depth < F.size(stack)), closed).otherwise(stack),
            s["seen"] + F.when(kind.isin("start", "whole"), 1).otherwise(0), s["node"] + shown.cast("int"),
            s["pos"] + F.when(shown, p["words"]).otherwise(0),
            F.when(shown, F.concat(s["found"], F.array(new))).otherwise(s["found"]))

    def part(s: Column, first: Column) -> Column:
        empty = state(s["stack"], s["seen"], s["node"], s["pos"], F.array())
        after = F.aggregate(F.slice(kinds, first + 1, F.lit(FOLD_PIECES)), empty, step)
        return F.struct(after["stack"].alias("stack"), after["seen"].alias("seen"), after["node"].alias("node"), after["pos"].alias("pos"),
                        F.concat(s["found"], F.array(after["found"])).alias("found"))

    body = F.array(F.struct(F.lit(0).alias("id"), F.lit("body").alias("tag"))).cast(_STACK)
    start = F.struct(body.alias("stack"), F.lit(0).alias("seen"), F.lit(0).alias("node"), F.lit(0).cast("bigint").alias("pos"),
                     F.array().cast(f"array<{_FOUND}>").alias("found"))
    firsts = F.sequence(F.lit(0), F.greatest(F.size(kinds) - 1, F.lit(0)), F.lit(FOLD_PIECES))
    return F.flatten(F.aggregate(firsts, start, part, lambda s: s["found"]))


def text_nodes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """One row per text with words: its node number, the place ``pos`` of its first word on the page, ``text``, the
    element it stands in and the nearest paragraph element, whose numbers count start tags."""
    pieces = pages.select(page, F.regexp_extract_all(F.col(html), F.lit(PIECE), F.lit(0)).alias("pieces"))
    found = pieces.withColumn("kinds", _piece_kinds(F.col("pieces"))).select(page, "pieces", F.explode(_fold(F.col("kinds"))).alias("f"))
    return found.select(page, F.col("f.node").cast("bigint").alias("node"), "f.pos", F.get("pieces", F.col("f.piece")).alias("text"),
                        "f.tag", F.col("f.paragraph").cast("bigint").alias("paragraph"), "f.paragraph_tag")


def html_nodes(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Words numbered by page and text node, each with the element it stands in and
    the nearest paragraph element."""
    words = text_nodes(pages, page, html).select("*", F.posexplode(text_words(F.col("text"))).alias("_at", "word"))
    return words.select(page, "word", "node", (F.col("pos") + F.col("_at")).alias("pos"), "tag", "paragraph", "paragraph_tag")


def paragraph_of(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """Word counts and span of places of each paragraph element."""
    nodes = text_nodes(pages, page, html).withColumn("_n", F.size(text_words(F.col("text"))).cast("bigint"))
    return nodes.groupBy(page, "paragraph", "paragraph_tag").agg(
        F.sum("_n").alias("words"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("_n") - 1).alias("last"))


def extract_links(pages: DataFrame, prefix: str = "/", page: str = "page_id", html: str = "html",
                  base: str | None = None) -> DataFrame:
    """Addresses of anchors that start with ``prefix``, in absolute form when the
    page's own address is given."""
    found = pages.select(page, *([base] if base else []),
                         F.explode(F.regexp_extract_all(F.col(html), F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), 1)).alias("href"))
    found = found.filter(F.col("href").startswith(prefix))
    if base is None:
        return found
    site = F.regexp_extract(F.col(base), r"^(https?://[^/?#]*)", 1)
    return found.select(page, "href", F.concat(site, "href").alias("url"))


def discover_pages(paths: DataFrame, kind: str = "kind", path: str = "path", depth: int = 2) -> DataFrame:
    """Paths that open a saved site: any html, htm or mhtml file at the top, and below
    it only files named index, at most ``depth`` folders down."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    level = F.size(parts) - 1
    is_page = F.lower(F.element_at(F.split(name, r"\."), -1)).isin("html", "htm", "mhtml") & name.contains(".")
    entry = (level == 0) | ((level <= depth) & (F.element_at(F.split(name, r"\."), 1) == "index"))
    return paths.filter(is_page & entry)
