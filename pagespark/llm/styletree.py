"""Main text of web pages by a site style tree.

Pages of one host are merged: a node is a host and a path of tags with their classes. Its
presentation importance is the entropy of how pages fill it (how many blocks stand there), in
bits and one at most; the content importance of a block in it falls with the share of the host's
pages that have the same text there. Neither depends on how many pages a host has. Blocks of low
importance are removed from each page: where all pages fill the node alike, those on more than 78
of 100 pages, elsewhere those on more than 89 at most. Other blocks of the node stay. Before that, branches that
their tag, role or class marks as menu, header, footer, sidebar, notice, advert, form, comment,
script or style are left out, and a page that has an article keeps only what is in it.

Pages of a host that are equal as a whole count once, so that copies of an article do not make
it look like boilerplate; a host with few pages has nothing removed by importance.

Counts are summed before the shuffle, so a host may hold any share of the pages; of a page
only hashes of its blocks meet those of other pages.

Left-out elements without an end tag: scripts and other raw text reach to the end of the page, as in
browsers; drawings and formulas end before the next block of text; others leave out nothing.

Defined results: null or empty html, or a page without main text, gives an empty text; a null
url is a host of its own; rows may repeat; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagespark.session import written

LEAST_PAGES = 4  # distinct pages of a host from which importance is judged
LEAST_IMPORTANCE = 0.2
DAMPING = 0.9  # weight of what stands in a node against how it is filled

# No part of it gives back what it took, and a tag ends before the next "<", so that a page is read once.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math")}
# Where left-out content ends if its end tag is missing: foreign elements end before a block of text.
FOREIGN = {x: re.compile(rf"</{x}\s*>|<(?:p|div|h[1-6]|[uod]l|table|blockquote|pre|section|article|main)(?=[\s>])|<(foreignobject)\b", re.I) for x in ("svg", "math")}
UNCLOSED_STAYS = ("noscript", "template", "svg", "math")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body br-block caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - {"br-block", "caption", "legend", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
              "option": ("option",)}
OUTSIDE = frozenset("nav footer aside form button select option dialog menu head label input object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notice|alert|popup|modal|"
    r"overlay|side-?bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|site-?header|masthead|topbar|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|"
    r"recommended|newsletter|subscribe|signup|login|search|widget|toolbar|pagination|pager|skip-?link|toc)(?=$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

PARSED_DDL = "page_id bigint, url string, host string, keys array<bigint>, paths array<bigint>, texts array<string>"


def _attributes(tag: str, raw: str) -> tuple[str, bool]:
    """(class text for the path, whether the attributes mark the branch as no main text)."""
    if not raw or "=" not in raw and "hidden" not in raw.lower():
        return "", False
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(raw)}
    names = found.get("class", "")
    out = (found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
           or bool(HIDDEN.search(found.get("style", ""))))
    if tag not in ("html", "body", "article", "main"):
        out = out or bool(MARKED.search(names)) or bool(MARKED.search(found.get("id", "")))
    return names, out


def _after_raw(tag: str, page: str, at: int, unclosed: set[str]) -> int:
    """Where the page goes on after the start tag of an element whose content is left out."""
    if tag in FOREIGN:
        m = FOREIGN[tag].search(page, at) if f"<{tag}" not in unclosed else None
        if m is None:
            unclosed.add(f"<{tag}")
            return at
        if not m[1]:
            return m.end() if m[0][1] == "/" else m.start()
    m = RAW[tag].search(page, at) if tag not in unclosed else None
    if m:
        return m.end()
    unclosed.add(tag)  # nor is there one further on
    return at if tag in UNCLOSED_STAYS else len(page)


def blocks_of(page: str) -> list[tuple[str, str]]:
    """(path, text) of the blocks of main text before importance is judged, in page order."""
    stack: list[tuple[str, str, bool, bool]] = []  # tag, path as a digest, left out, in an article
    opened: Counter[str] = Counter()  # tags of the stack, so that it is not searched for what it lacks
    unclosed: set[str] = set()
    blocks: list[tuple[str, str, bool]] = []
    parts: list[str] = []
    where: tuple[str, bool] | None = None

    def flush() -> None:
        nonlocal parts, where
        if parts and where:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((where[0], text, where[1]))
        parts, where = [], None

    def close(upto: int) -> None:
        if any(x[0] in BLOCK for x in stack[upto:]):
            flush()
        opened.subtract(x[0] for x in stack[upto:])
        del stack[upto:]

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            token = m[0]
            if token[0] != "<" or token == "<":
                if stack and stack[-1][2]:
                    continue
                if where is None and token.strip():
                    where = (stack[-1][1], stack[-1][3]) if stack else ("", False)
                parts.append(token)
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] and tag not in VOID:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        close(i)
                        break
                    if stack[i][0] in ("article", "main", "body", "table") and tag not in ("html", "body", "article", "main"):
                        break  # a stray end tag does not leave the article
            continue
        if tag == "br":
            parts.append("\n")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag not in FOREIGN:
                at = _after_raw(tag, page, at, unclosed)
            continue
        if tag in CLOSES_P and opened["p"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("article", "div", "section", "td", "th", "table", "button", "body"):
                    break
        if any(opened[x] for x in SAME_LEVEL.get(tag, ())):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SAME_LEVEL[tag]:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag in BLOCK:
            flush()
        names, out = _attributes(tag, m[3])
        up = stack[-1] if stack else ("", "", False, False)
        article = up[3] or tag in ("article", "main")
        out = up[2] or out or tag in OUTSIDE or tag == "header" and not up[3]
        path = format(_hash(f"{up[1]}/{tag}.{names}") & (1 << 64) - 1, "x") if tag in BLOCK else up[1]
        stack.append((tag, path, out, article))
        opened[tag] += 1
    flush()
    inside = [(p, t) for p, t, article in blocks if article]
    return inside or [(p, t) for p, t, _ in blocks]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Blocks of every page: their texts, hashed paths, and hashes of path and text together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "host", "keys", "paths", "texts"]
        whole, strings = pa.list_(pa.int64()), pa.list_(pa.string())
        for batch in batches:
            keys, paths, texts, hosts = [], [], [], []
            for url, page in zip(batch.column(1), batch.column(2)):
                host = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url.as_py() or "")
                host = host[1].lower() if host else ""
                own = blocks_of(page.as_py() or "")
                hosts.append(host)
                paths.append([_hash(f"{host}\0{p}") for p, _ in own])
                keys.append([_hash(f"{host}\0{p}\0{t}") for p, t in own])
                texts.append([t for _, t in own])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(hosts, type=pa.string()), pa.array(keys, type=whole),
                pa.array(paths, type=whole), pa.array(texts, type=strings)], names=names)

    chosen = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return chosen.mapInArrow(run, PARSED_DDL)


def _entropy(counts, total):
    """Entropy in bits of shares c / total, given the sum of c * ln c."""
    return (F.log(total) - counts / total) / F.log(F.lit(2.0))


def low_keys(parsed: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """Hashes of blocks (path and text) that are to go, as one column ``key``."""
    distinct = parsed.select("host", "keys", "paths").groupBy("host", F.xxhash64("keys").alias("_page")).agg(
        F.any_value("keys").alias("keys"), F.any_value("paths").alias("paths"))
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least_pages)
    spots = distinct.select("host", "_page", F.explode(F.arrays_zip("keys", "paths")).alias("b")).select(
        "host", "_page", F.col("b.keys").alias("key"), F.col("b.paths").alias("path"))
    per_page = spots.groupBy("host", "path", "_page").agg(F.count("*").alias("n"))
    styles = (
        per_page.groupBy("host", "path", "n").agg(F.count("*").alias("c")).groupBy("host", "path")
        .agg(F.sum(F.col("c") * F.log("c")).alias("clogc"), F.sum("c").alias("with_path"))
    )
    contents = spots.groupBy("host", "path", "key").agg(F.count_distinct("_page").alias("k"))
    nodes = styles.join(pages, "host").select(
        "host", "path", "pages", F.least(_entropy(F.col("clogc"), F.col("with_path")), F.lit(1.0)).alias("style"))
    importance = (1 - DAMPING) * F.col("style") + DAMPING * (1 - F.col("k") / F.col("pages"))
    return contents.join(nodes, ["host", "path"]).filter(importance < least).select("key")


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text of the blocks that stay, and n_removed blocks of low importance."""
    parsed = written(parse_pages(pages).withColumn("_row", F.monotonically_increasing_id()), "blocks")
    low = low_keys(parsed, least_pages, least)
    gone = (
        parsed.select("_row", F.explode("keys").alias("key")).distinct().join(low, "key")
        .groupBy("_row").agg(F.collect_set("key").alias("gone"))  # bounded by a page's blocks
    )
    gone = written(gone, "removed")  # its size on disk is known when Spark picks the join
    kept = F.filter(F.arrays_zip("keys", "texts"), lambda b: ~F.coalesce(F.array_contains("gone", b["keys"]), F.lit(False)))
    return parsed.join(gone, "_row", "left").select(
        "page_id", "url", F.array_join(F.transform(kept, lambda b: b["texts"]), " ").alias("text"),
        (F.size("keys") - F.size(kept)).cast("bigint").alias("n_removed"))
