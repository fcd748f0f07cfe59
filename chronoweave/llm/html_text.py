"""Main text of web pages: elements that recur over a site's pages are removed.

Two passes. The first hashes the subtrees of block elements of every page and
counts, in Spark, on how many pages of a host each hash occurs. The second
drops subtrees that recur, with elements that by name, role or class never hold
the article, and joins what is left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import persisted

#: Elements whose content is raw text up to their end tag.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes")
#: Elements that never hold the article.
DROP = frozenset(RAW) | {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "svg", "canvas", "object", "embed", "audio", "video", "map", "menu", "dialog", "label", "input", "fieldset", "math"}
#: Elements without content.
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
#: Elements that start a new block of text.
BLOCKS = frozenset({
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
})
#: Elements whose end another start implies.
CLOSES = {
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
#: Fixed words of class and id names of parts that aren't the article, words that may stand before them, and after them. A name counts as a whole: ``no-sidebar`` or ``tag-legal`` say nothing.
_PARTS = r"ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menus?|breadcrumbs?|side-?bar|footer|masthead|top-?bar|tool-?bar|cookies?|consent|gdpr|notices?|popup|modal|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|repl(?:y|ies)|respond|widgets?|pagination|pager|skip-link|copyright|legal|disclaimer|alert|toast|paywall"
_BEFORE = r"site|page|main|top|bottom|left|right|global|primary|secondary|user|reader|post|article|entry|blog|legal|cookie|social|site-wide"
_AFTER = r"list|items?|box|bar|wrap|wrapper|container|section|block|area|links?|buttons?|inner|menu|banner|notice|form|popup|overlay|panel|posts|articles|stories|media|icons|widgets?|thread|text|note|primary|secondary|left|right|top|bottom|main|\d+"
NOT_ARTICLE = re.compile(rf"(?:(?:{_BEFORE})[_-])?(?:{_PARTS})(?:[_-](?:{_AFTER}))*", re.I)
#: Roles of parts that aren't the article.
NOT_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"})

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*[^>]*(?:>|\Z)", re.I) for name in RAW}


#: How surely an element never holds the article: not at all, by its class or id (unless the article or its heading is in it), by its name, role or being hidden.
NO, MAYBE, NEVER = 0, 1, 2


def _never(name: str, attributes: str) -> int:
    if name in DROP:
        return NEVER
    if not attributes or name in ("html", "body", "main", "article"):
        return NO
    found = NO
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if any(map(NOT_ARTICLE.fullmatch, value.split())):
                found = MAYBE
        elif key == "role":
            if value.lower() in NOT_ROLES:
                return NEVER
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return NEVER
    return found


def _tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of the tags and texts of a page, in time linear in its length.

    A tag ends at the first ``>`` outside of quotes. On a page with a quote
    that never closes, tags from there on end at the first ``>``. What looks
    like a tag but has no end is text.
    """
    at, size, quoted = 0, len(html), True
    while at < size:
        begin = html.find("<", at)
        if begin < 0:
            yield "text", html[at:], ""
            return
        if begin > at:
            yield "text", html[at:begin], ""
        if html.startswith("<!--", begin):
            end = html.find("-->", begin + 4)
            at = end + 3 if end >= 0 else size
            continue
        if html[begin + 1 : begin + 2] in ("!", "?"):
            at = html.find(">", begin) + 1 or size
            continue
        closing = html.startswith("/", begin + 1)
        name = _NAME.match(html, begin + 1 + closing)
        if name is None:
            yield "text", "<", ""
            at = begin + 1
            continue
        end, from_ = -1, name.end()
        while quoted:
            stop = _STOP.search(html, from_)
            if stop is None or stop[0] == ">":
                end, quoted = stop.start() if stop else -1, stop is not None
                break
            close = html.find(stop[0], stop.end())
            if close < 0:
                quoted = False
            from_ = close + 1
        if end < 0:
            end = html.find(">", name.end())
        if end < 0:
            yield "text", html[begin:], ""
            return
        at = end + 1
        value, lowered = html[name.end() : end], name[0].lower()
        yield "end" if closing else "start", lowered, value
        if not closing and lowered in _RAW_END and not value.endswith("/"):
            over = _RAW_END[lowered].search(html, at)
            yield "end", lowered, ""
            at = over.end() if over else size


def events(html: str) -> Iterator[tuple[str, str, int]]:
    """A page as (kind, name or text, NO, MAYBE or NEVER): start, end, void and text, balanced.

    Elements that a page leaves open are closed where their parent ends, an end
    tag without its start is passed over.
    """
    stack: list[str] = []
    depth: dict[str, int] = {}

    def close() -> tuple[str, str, int]:
        last = stack.pop()
        depth[last] -= 1
        return "end", last, NO

    for kind, name, attributes in _tokens(html):
        if kind == "text":
            yield "text", name, NO
        elif kind == "end":
            if depth.get(name, 0):
                while stack[-1] != name:
                    yield close()
                yield close()
            elif name in ("p", "br"):
                yield "void", name, NO
        else:
            never = _never(name, attributes)
            if name in VOID or attributes.endswith("/"):
                yield "void", name, never
                continue
            if name in BLOCKS and stack and stack[-1] == "p":
                yield close()
            closes = CLOSES.get(name, ())
            while stack and stack[-1] in closes:
                yield close()
            stack.append(name)
            depth[name] = depth.get(name, 0) + 1
            yield "start", name, never
    while stack:
        yield close()


#: Elements that tell where the article is: what holds one is no part beside it.
_HOLD = frozenset({"article", "main", "h1"})


def _settled(html: str) -> list[tuple[str, str, bool]]:
    """The events, with whether an element never holds the article."""
    found = list(events(html))
    out: list[tuple[str, str, bool]] = []
    held, opened = 0, []
    for kind, value, never in found:
        if kind == "start":
            opened.append((len(out), held))
            held += value in _HOLD
        elif kind == "end":
            at, before = opened.pop()
            if found[at][2] == MAYBE and held - (value in _HOLD) == before:
                out[at] = ("start", value, True)
        out.append((kind, value, never == NEVER))
    return out


#: Elements that hold a page or its article, and so aren't subtrees of a template themselves.
_FRAMES = frozenset({"html", "body", "main", "article"})
#: Elements in an article that can belong to a template. Its prose can't: a passage that many articles quote stays.
_CONTAINERS = frozenset({"div", "section", "ul", "ol", "dl", "table", "figure", "details", "center"})
#: Places of blocks: in an article within main, in main, in another article, elsewhere.
MAIN_ARTICLE, MAIN, ARTICLE, ELSEWHERE = 3, 2, 1, 0
#: Different pages of a host on which a subtree recurs at least to be a template, whatever the size of the host.
MIN_PAGES = 5


@dataclass
class Page:
    """blocks: (subtree, text, place) in page order. parents and hashes: of each subtree; hash None: never a template."""

    blocks: list[tuple[int, str, int]]
    parents: list[int]
    hashes: list[int | None]


def parse(html: str) -> Page:
    """The blocks of a page outside of elements that never hold the article.

    A subtree is a block element; its hash covers the element names and texts
    in it, white space folded.
    """
    parents: list[int] = []
    hashes: list[int | None] = []
    out: list[tuple[int, str, int]] = []
    opened: list[tuple[str, int, int, object]] = []  # name, subtree outside, place outside, hash so far
    skipped, here, place, text = 0, -1, ELSEWHERE, []

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                out.append((here, joined, place))
                if opened:
                    opened[-1][3].update(joined.encode("utf-8", "replace") + b"\0")

    for kind, value, never in _settled(html):
        if skipped:
            skipped += (kind == "start") - (kind == "end")
        elif kind == "text":
            text.append(value)
        elif kind == "void":
            if value in BLOCKS:
                flush()
        elif kind == "start":
            if never:
                if value in BLOCKS:
                    flush()
                skipped = 1
            elif value in BLOCKS:
                flush()
                opened.append((value, here, place, xxhash.xxh64(value.encode())))
                if value == "article":
                    place = MAIN_ARTICLE if place >= MAIN else ARTICLE
                elif value == "main":
                    place = max(place, MAIN)
                elif value not in _FRAMES:
                    parents.append(here)
                    here = len(hashes)
                    hashes.append(None)
        elif value in BLOCKS and opened:
            flush()
            name, outside, before, digest = opened.pop()
            if name not in _FRAMES:
                if place in (ELSEWHERE, MAIN) or name in _CONTAINERS:
                    hashes[here] = digest.intdigest() - (1 << 63)
            here, place = outside, before
            if opened:
                opened[-1][3].update(digest.digest())
    flush()
    return Page(out, parents, hashes)


def subtrees(page: Page) -> set[int]:
    """Hashes of the subtrees with text that can be templates."""
    filled: set[int] = set()
    for own, _, _ in page.blocks:
        while own >= 0 and own not in filled:
            filled.add(own)
            own = page.parents[own]
    return {page.hashes[k] for k in filled if page.hashes[k] is not None}


def main_text(html: str | None, templates: set[int] | frozenset[int] = frozenset()) -> str:
    """The article: of the blocks outside of template subtrees those in main elements, else in articles if these hold a quarter of the text, else all; joined by spaces."""
    page = parse(html or "")
    dropped: list[bool] = []
    for parent, digest in zip(page.parents, page.hashes):  # parents come first
        dropped.append((parent >= 0 and dropped[parent]) or digest in templates)
    left = [(place, text) for own, text, place in page.blocks if own < 0 or not dropped[own]]
    of = lambda *places: [text for place, text in left if place in places]
    main, every = of(MAIN, MAIN_ARTICLE), of(MAIN, MAIN_ARTICLE, ARTICLE, ELSEWHERE)
    article = of(ARTICLE)
    if not main and 4 * sum(map(len, article)) < sum(map(len, every)):
        article = []
    return " ".join(main or article or every)


def _subtree_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, html) to (host, page, subtree) for the subtrees of each page."""
    for batch in batches:
        found = [sorted(subtrees(parse(html.as_py() or ""))) for html in batch.column(2)]
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        flat = np.array([h for own in found for h in own], np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(flat)], ["host", "page", "subtree"])


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), set(t.as_py() or ())) for h, t in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


#: Bound of a broadcast table of pages' templates: pages, and hashes in all (8 bytes each).
BROADCAST_PAGES, BROADCAST_HASHES = 200_000, 2_000_000


def _with_host(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"))


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, page, templates): of each page, told by a hash of its html, the subtrees that at least ``min_pages`` different pages of its host hold.

    Copies of a page count once. Pages without a host in their URL have no
    templates. Counts are pre-aggregated and the subtrees go back to the pages
    that hold them, so that neither a host of very many pages nor its
    templates are one task or one row.
    """
    rows = _with_host(pages).where("host <> ''").select("host", "page", "html").mapInArrow(_subtree_batches, "host string, page long, subtree long")
    rows = persisted(rows.distinct(), "subtrees")
    recurring = rows.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("host", "subtree")
    return rows.join(recurring, ["host", "subtree"]).groupBy("host", "page").agg(F.collect_list("subtree").alias("templates"))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit(""))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """The main text of every page, from the whole html.

    A null html is an empty page; a null or odd url has no host, and such
    pages lose no templates. Repeated rows give repeated results, an empty
    table gives no rows. Only page_id, url and html are read, whatever other
    columns are named.

    Returns page_id, url, text (empty if none) and n_chars, its code points.
    """
    found = persisted(site_templates(pages, min_pages), "templates")
    size = found.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("hashes")).first()
    if size["pages"] <= BROADCAST_PAGES and size["hashes"] <= BROADCAST_HASHES:
        found = F.broadcast(found)
    joined = _with_host(pages).join(found, ["host", "page"], "left").select("page_id", "url", "html", "templates")
    ids = pages.schema["page_id"].dataType.simpleString()
    texts = joined.mapInArrow(_extract_batches, f"page_id {ids}, url string, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
