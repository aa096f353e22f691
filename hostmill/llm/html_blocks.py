"""Main-text extraction: flat text blocks judged by a decision tree.

A page is cut into flat blocks at block-level tags. Each block has its word count and link
density, those of its neighbours, and two hints from the tags around it. A small decision
tree, grown here from the labelled table below, says which blocks are content. Where the tags
around a block say what it is, the tree goes by that first, since short article lines and
adverts have the same counts; elsewhere it goes by words and link density.

A hint from a class, id or role, or from a form around, is loose. It is cleared where its
element holds most of the page's unlinked words, and inside an article or main below it,
unless articles outside such elements have as many unlinked words.

Defined cases: a null, empty or text-less html gives an empty text; unclosed tags, broken
character references and truncated pages are read as far as they go; equal rows give equal
results; an empty table gives no rows; only page_id, url and html are read. Long pages cost
time in proportion to their length.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_columns, table

FEATURES = ("words", "link_density", "prev_words", "prev_density", "next_words", "next_density", "boiler", "article")

#: The labelled blocks the tree is grown from: the features in the order of
#: FEATURES, then 1 for content and 0 for the rest.
LABELLED = (
    # menus
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 12, 0.0, 1, 0, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (6, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0),
    (9, 0.9, 1, 1.0, 60, 0.0, 0, 0, 0), (14, 0.8, 30, 0.0, 1, 1.0, 0, 0, 0),
    # adverts, notices, sidebars, footers, forms, comments: told by the tags around them
    (12, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), (5, 0.0, 1, 1.0, 30, 0.0, 1, 0, 0), (15, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0),
    (40, 0.0, 120, 0.0, 0, 0.0, 1, 0, 0), (25, 0.2, 60, 0.0, 60, 0.0, 1, 1, 0), (60, 0.0, 90, 0.0, 20, 0.0, 1, 1, 0),
    (3, 0.0, 50, 0.0, 4, 0.5, 1, 1, 0), (200, 0.0, 10, 0.0, 10, 0.0, 1, 1, 0), (80, 0.0, 10, 0.0, 10, 0.0, 1, 0, 0),
    (1, 0.0, 40, 0.0, 40, 0.0, 1, 1, 0), (30, 0.1, 2, 1.0, 2, 1.0, 1, 0, 0),
    # the article, short lines and linked words included
    (8, 0.0, 12, 0.0, 90, 0.0, 0, 1, 1), (120, 0.0, 8, 0.0, 60, 0.0, 0, 1, 1), (1, 0.0, 80, 0.0, 70, 0.0, 0, 1, 1),
    (2, 0.0, 2, 0.0, 2, 0.0, 0, 1, 1), (30, 0.1, 50, 0.0, 40, 0.0, 0, 1, 1), (5, 0.0, 60, 0.0, 15, 0.0, 0, 1, 1),
    (12, 0.3, 60, 0.0, 60, 0.0, 0, 1, 1), (4, 1.0, 60, 0.0, 60, 0.0, 0, 1, 1), (1, 1.0, 1, 0.0, 1, 0.0, 0, 1, 1),
    (3, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (9, 0.0, 1, 1.0, 0, 0.0, 0, 1, 1), (6, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1),
    # titles and short lines of the article after a menu or a linked line
    (2, 0.0, 1, 1.0, 30, 0.0, 0, 1, 1), (3, 0.0, 4, 1.0, 60, 0.0, 0, 1, 1), (1, 0.0, 2, 1.0, 80, 0.0, 0, 1, 1), (2, 0.0, 6, 1.0, 0, 0.0, 0, 1, 1),
    (4, 0.0, 1, 1.0, 12, 0.0, 0, 1, 1), (5, 0.0, 3, 0.8, 20, 0.0, 0, 1, 1), (2, 0.0, 1, 1.0, 1, 1.0, 0, 1, 1), (1, 0.0, 5, 0.7, 3, 0.0, 0, 1, 1),
    # the same without an article element: a short line before a long text is a title
    (2, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (3, 0.0, 1, 1.0, 80, 0.0, 0, 0, 1), (4, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1), (1, 0.0, 1, 1.0, 120, 0.0, 0, 0, 1),
    # pages without an article element
    (60, 0.0, 5, 0.0, 70, 0.0, 0, 0, 1), (45, 0.1, 90, 0.0, 3, 1.0, 0, 0, 1), (30, 0.0, 50, 0.0, 40, 0.1, 0, 0, 1),
    (8, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (2, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (20, 0.0, 2, 1.0, 50, 0.0, 0, 0, 1),
    (7, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1), (100, 0.2, 1, 1.0, 1, 1.0, 0, 0, 1), (16, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0),
    # blocks of the given pages, as found
    (15, 0.0, 10, 0.0, 0, 0.0, 1, 0, 0), (13, 0.0, 44, 0.0, 0, 0.0, 1, 0, 0), (8, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0), (13, 0.0, 1, 1.0, 6, 0.0, 1, 0, 0),
    (1, 1.0, 1, 1.0, 10, 0.0, 1, 0, 0), (9, 0.0, 150, 0.0, 0, 0.0, 1, 0, 0), (122, 0.0, 21, 0.0, 48, 0.0, 0, 1, 1), (10, 0.0, 109, 0.0, 20, 0.0, 0, 1, 1),
    (4, 0.0, 73, 0.0, 32, 0.0, 0, 1, 1), (8, 0.0, 1, 0.0, 4, 0.0, 0, 1, 1), (1, 0.0, 8, 0.0, 136, 0.0, 0, 1, 1), (6, 0.0, 2, 0.0, 11, 0.0, 0, 1, 1),
    # blocks of the given pages, without what the tags around them say
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 13, 0.0, 0, 0, 0), (1, 1.0, 1, 1.0, 4, 0.0, 0, 0, 0),
    (55, 0.0, 39, 0.0, 67, 0.0, 0, 0, 1), (2, 0.0, 27, 0.0, 15, 0.0, 0, 0, 1), (78, 0.0, 44, 0.0, 94, 0.0, 0, 0, 1), (17, 0.0, 29, 0.0, 4, 0.0, 0, 0, 1),
    (26, 0.0, 62, 0.0, 11, 0.0, 0, 0, 1), (44, 0.0, 1, 0.0, 14, 0.0, 0, 0, 1), (33, 0.0, 5, 0.0, 39, 0.0, 0, 0, 1), (65, 0.0, 15, 0.0, 31, 0.0, 0, 0, 1),
    (15, 0.0, 155, 0.0, 12, 0.0, 0, 0, 1), (5, 0.0, 11, 0.0, 41, 0.0, 0, 0, 1), (11, 0.0, 78, 0.0, 7, 0.0, 0, 0, 1), (12, 0.0, 46, 0.0, 1, 0.0, 0, 0, 1),
    (15, 0.0, 1, 0.0, 65, 0.0, 0, 0, 1), (3, 0.0, 22, 0.0, 34, 0.0, 0, 0, 1), (156, 0.0, 94, 0.0, 33, 0.0, 0, 0, 1), (4, 0.0, 17, 0.0, 2, 0.0, 0, 0, 1),
    (7, 0.0, 83, 0.0, 2, 0.0, 0, 0, 1), (73, 0.0, 3, 0.0, 193, 0.0, 0, 0, 1), (10, 0.0, 98, 0.0, 3, 0.0, 0, 0, 1), (8, 0.0, 12, 0.0, 90, 0.0, 0, 0, 1),
)

_SKIPPED = "script|style|noscript|template|svg|math|title|textarea|select|iframe|object|canvas|audio|video"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:{_SKIPPED})\b(?:(?!/>)[^>])*>.*?(?:</(?:{_SKIPPED})\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER_TAGS = frozenset("nav aside footer menu button".split())
_LOOSE_TAGS = frozenset("form dialog fieldset".split())
_BOILER_WORDS = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|popup|modal|nav|navbar|navigation|menu"
    r"|breadcrumb\w*|side|sidebar|widget|footer|header|masthead|comment\w*|disqus|replies|reply|respond|share|sharing|social|related"
    r"|recommend\w*|newsletter|subscribe|subscription|signup|login|search|form|pagination|pager|toolbar|skip|alert|copyright)",
    re.I,
)
#: Parts that a hinting token may have beside such words.
_NEUTRAL = frozenset("site main left right top bottom primary secondary global area bar list box links link buttons posts section".split())
_PARTS = re.compile(r"[_-]+")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def is_hint(token: str) -> bool:
    """Whether a whole class, id or role says boilerplate: all its parts do or are neutral."""
    parts = [x for x in _PARTS.split(token.lower()) if x and x not in _NEUTRAL]
    return bool(parts) and all(map(_BOILER_WORDS.fullmatch, parts))


def hints(attrs: str) -> tuple[bool, bool]:
    """From a tag's attributes: a loose hint, and whether it is hidden."""
    loose = hidden = False
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            loose = loose or any(map(is_hint, value.split()))
        elif name == "hidden":
            hidden = hidden or value.lower() != "false"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or bool(_UNSEEN.search(value))
    return loose, hidden


def grow(rows, depth: int = 5, least: int = 1):
    """A CART by Gini impurity: a leaf is its label, a node (feature, threshold, low, high)."""
    ones = sum(r[-1] for r in rows)
    majority = int(2 * ones >= len(rows))
    if depth == 0 or ones in (0, len(rows)):
        return majority
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            cut = (a + b) / 2
            low = [r for r in rows if r[f] <= cut]
            high = [r for r in rows if r[f] > cut]
            if min(len(low), len(high)) < least:
                continue
            cost = 0.0
            for part in (low, high):
                p = sum(r[-1] for r in part) / len(part)
                cost += len(part) * p * (1 - p)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut, low, high)
    if best is None:
        return majority
    _, f, cut, low, high = best
    return f, cut, grow(low, depth - 1, least), grow(high, depth - 1, least)


def judge(tree, x) -> int:
    while not isinstance(tree, int):
        f, cut, low, high = tree
        tree = low if x[f] <= cut else high
    return tree


def blocks(page: str) -> list[tuple[str, int, int, int, int]]:
    """(text, words, linked words, boiler, article) of every flat block, in page order."""
    found: list[tuple[str, int, int, bool, bool, int]] = []  # as returned, and the loose place
    # Tag, boiler, article, loose place: of it and all around it. A loose place is the innermost
    # element with a loose hint, or article below one; 0 is outside of all.
    open_tags: list[tuple[str, bool, bool, int]] = []
    around, is_article = [0], [False]
    is_open: dict[str, int] = {}
    parts: list[str] = []
    linked: list[str] = []
    in_link = 0
    own = False  # a hint on the block's own tag

    def flush() -> None:
        nonlocal own
        text = " ".join(html_lib.unescape("".join(parts)).split()) if parts else ""
        if text:
            n = text.count(" ") + 1
            m = min(n, len(html_lib.unescape(" ".join(linked)).split())) if linked else 0
            boiler, article, place = open_tags[-1][1:] if open_tags else (False, False, 0)
            found.append((text, n, m, boiler or own, article, place))
        parts.clear()
        linked.clear()
        own = False

    at = 0
    for t in _TOKEN.finditer(page):
        if t.start() > at:
            piece = page[at : t.start()]
            parts.append(piece)
            if in_link:
                linked.append(piece)
        at = t.end()
        tag = t["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if t["end"] else 1
            elif tag == "br":
                parts.append(" ")
            continue
        flush()
        in_link = 0
        if t["end"]:
            while is_open.get(tag):  # an end tag closes all up to its own, if that is open
                last = open_tags.pop()[0]
                is_open[last] -= 1
                if last == tag:
                    break
            continue
        if tag in _VOID:
            continue
        attrs = t["attrs"] or ""
        _, boiler, article, place = open_tags[-1] if open_tags else ("", False, False, 0)
        hinted = tag in _BOILER_TAGS or (tag == "header" and not article)
        loose = tag in _LOOSE_TAGS
        if attrs and tag not in ("html", "body"):
            named, hidden = hints(attrs)
            loose, hinted = loose or named, hinted or hidden
        if tag in ("p", "li", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"):
            own = hinted or loose  # often unclosed: the hint lasts for this block alone
            continue
        if tag in ("article", "main"):
            article = True
            if tag == "main":
                hinted = loose = False
            if place:
                around.append(place)
                is_article.append(True)
                place = len(around) - 1
        if loose:
            around.append(place)
            is_article.append(False)
            place = len(around) - 1
        open_tags.append((tag, boiler or hinted, article, place))
        is_open[tag] = is_open.get(tag, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return settled(found, around, is_article)


def settled(found: list, around: list[int], is_article: list[bool]) -> list[tuple[str, int, int, int, int]]:
    """The blocks with those loose hints that aren't cleared."""
    words = [0] * len(around)
    free = below = 0
    for _, n, m, boiler, article, place in found:
        words[place] += n - m
        if article and not boiler:
            free += 0 if place else n - m
            below += n - m if is_article[place] else 0
    for k in range(len(around) - 1, 0, -1):
        words[around[k]] += words[k]
    hint = [False] * len(around)
    for k in range(1, len(around)):
        if is_article[k]:
            hint[k] = hint[around[k]] and below <= free
        else:
            hint[k] = hint[around[k]] or 2 * words[k] <= words[0]
    return [(text, n, m, int(boiler or hint[place]), int(article)) for text, n, m, boiler, article, place in found]


def main_text(page: str | None, tree) -> str:
    if not page:
        return ""
    b = blocks(page)
    kept = []
    for k, (text, n, m, boiler, article) in enumerate(b):
        before = b[k - 1] if k else ("", 0, 0)
        after = b[k + 1] if k + 1 < len(b) else ("", 0, 0)
        x = (
            n, m / n, before[1], before[2] / before[1] if before[1] else 0.0,
            after[1], after[2] / after[1] if after[1] else 0.0, boiler, article,
        )
        if judge(tree, x):
            kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The pages' page_id and url with ``text``, the content blocks joined by newlines."""
    tree = grow(list(LABELLED))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x, tree) for x in batch], dtype=object)

    p = own_columns(pages, "page_id", "url", html_col)
    return p.select("page_id", "url", run(F.col(f"`{html_col}`")).alias("text"))


def op5_html_blocks(spark, sf_dir: str) -> DataFrame:
    d = extract(table(spark, sf_dir, "pages"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
