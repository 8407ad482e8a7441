"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags; inline tags do not break a block). Every block has a
root-to-leaf tag path. Per path, text length and punctuation are added up and divided by the number of its blocks;
both ratios are smoothed over neighbouring blocks, fused by their product, and blocks of paths whose smoothed ratio
reaches ``SPREAD`` standard deviations are the core of the content. The content region is the innermost article or main
element that holds nearly all of the core, or else all of these elements together if they hold most of it, otherwise the
stretch of the page from the first to the last core block. All blocks of the
region are kept, short ones and headings included, except those inside excluded elements (navigation, header, footer,
aside, form, script, style and the like, or elements whose class, id or role names an advert, a notice, reader comments
and the like) and lists that consist of links.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by one space. Nothing else is dropped and no length is limited.

Edge cases: null and empty html give an empty text; pages without tags are one block; open and unmatched tags are
closed where their parent ends; repeated rows give equal rows; other columns pass through ``with_main_text``
(a column of the result's name is replaced).
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPREAD = 0.5
REGION_SHARE = 0.5
WHOLE_SHARE = 0.8
LINK_SHARE = 0.8

# Fixed values of HTML: elements that break a block, raw-text elements, elements without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol "
    "option p pre section select summary table tbody td template textarea tfoot th thead title tr ul video "
    "iframe button object audio svg".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: a new element of the key ends an open element of the values
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
        "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "body": ("head",)}
SCOPES = frozenset("table ul ol dl td th div section article main body".split())
# Elements and names that are not part of an article.
EXCLUDED_TAGS = frozenset(
    "head script style noscript template nav header footer aside form button select option textarea title iframe "
    "object svg canvas audio video dialog menu fieldset input".split())
EXCLUDED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist disqus "
    "replies reply respond share sharing social related recommended widget toolbar pagination pager login search "
    "contentinfo complementary".split())
#: longer names that begin or end like this count too (cookiebar, commentlist, sitefooter)
EXCLUDED_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "newsletter", "promo", "sidebar", "sponsor",
                   "subscri")
EXCLUDED_ENDS = ("banner", "comments", "footer", "header", "menu", "navbar", "navigation", "sidebar")
UNNAMED_TAGS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())  # never excluded by their names
REGION_TAGS = frozenset(("article", "main"))


def names_no_content(value: str) -> bool:
    """Whether a class, id or role names something that is no part of an article."""
    return any(w in EXCLUDED_NAMES or w.startswith(EXCLUDED_STARTS) or w.endswith(EXCLUDED_ENDS)
               for w in _WORD.findall(value.lower()))


_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[^\w\s]")


def next_token(source: str, at: int, last: int):
    """(start, end, end tag, name, attributes, self-closed) of the next markup from ``at`` on, None without one; the name is
    empty for comments, CDATA and declarations, which run to the end of the page if nothing closes them.

    A tag ends at the first ``>`` outside quotes; with a quote that never closes, at the first ``>``. ``last`` is the place
    of the last ``>`` of the page: no tag begins behind it, so no search for one runs over the rest again and again.
    """
    while True:
        start = source.find("<", at)
        if start < 0:
            return None
        for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if source.startswith(opening, start):
                end = source.find(closing, start + len(opening))
                return start, len(source) if end < 0 else end + len(closing), "", "", "", False
        m = _TAG.match(source, start) if start < last else None
        if m is None:
            at = start + 1
            continue
        place = m.end()
        if place > last:
            at = start + 1
            continue
        while (stop := _STOP.search(source, place)) is not None:
            if stop[0] == ">":
                inside = source[m.end():stop.start()]
                closed = inside.endswith("/")
                return start, stop.end(), m[1], m[2], inside[:-1] if closed else inside, closed
            place = source.find(stop[0], stop.end()) + 1
            if not place:
                break
        end = source.find(">", m.end())
        return start, end + 1, m[1], m[2], source[m.end():end], False


class Page:
    """Elements (parent, tag, path, excluded) and blocks (element, text, length of link text) of one page."""

    def __init__(self, source: str):
        self.parent, self.tag, self.path, self.by_name = [-1], [""], [0], [False]
        self.excluded = [False]
        self.paths: dict = {}
        self.blocks: list = []
        self._text, self._link, self._links = [], 0, 0
        self._read(source)

    def _flush(self, element):
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((element, text, self._link))
        self._text, self._link = [], 0

    def _open(self, element, tag, attributes):
        named = False
        if attributes and tag not in UNNAMED_TAGS:
            named = any(names_no_content(value) for value in _NAMES.findall(attributes))
        if tag == "article" and attributes:  # a reader comment may be marked up as an article
            named = any("comment" in v.lower() for v in _NAMES.findall(attributes))
        self.parent.append(element)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[element], tag), len(self.paths) + 1))
        self.by_name.append(named)
        self.excluded.append(self.excluded[element] or tag in EXCLUDED_TAGS
                             or bool(attributes and re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes)))
        return len(self.parent) - 1

    def _read(self, source):
        stack = [0]   # open elements; blocks belong to the innermost block-level one
        home = [0]
        at, last = 0, source.rfind(">")

        def close_to(depth):
            nonlocal stack
            while len(stack) > depth:
                e = stack.pop()
                if self.tag[e] == "a":
                    self._links -= 1
                if home[-1] == e:
                    self._flush(e)
                    home.pop()

        def add(text):
            if text:
                if "&" in text:
                    text = html.unescape(text)
                self._text.append(text)
                if self._links:
                    self._link += len(text)

        while True:
            token = next_token(source, at, last)
            if token is None:
                add(source[at:])
                break
            start, end, closing, name, attributes, closed = token
            add(source[at:start])
            at = end
            if not name:
                continue
            name = name.lower()
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        close_to(depth)
                        break
                    if name in ("p", "li", "b", "i", "a", "span", "em", "strong") and self.tag[stack[depth]] in SCOPES:
                        break
                if name == "br":
                    self._text.append(" ")
                continue
            if name == "br":
                self._text.append(" ")
                continue
            if name in BLOCK_TAGS:
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tag[stack[depth]]
                    if tag == "p" or tag in ENDS.get(name, ()):
                        close_to(depth)
                        if tag not in ENDS.get(name, ()) or name in ("li", "option"):
                            break
                    elif tag in SCOPES and tag not in ENDS.get(name, ()):
                        break
                self._flush(home[-1])
            if name in VOID_TAGS or (closed and name == "a" and not attributes.endswith("=")):
                continue
            if name in RAW_TAGS:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at, max(at, last + 1))
                at = end.end() if end else len(source)
                continue
            element = self._open(stack[-1], name, attributes)
            stack.append(element)
            if name in BLOCK_TAGS:
                home.append(element)
            if name == "a":
                self._links += 1
        close_to(1)
        self._flush(0)

    def settle_names(self):
        """Exclude named elements, unless one holds a region element, or nearly all the text that is left and no region
        or paragraph lies outside it (a wrapper of the page, whose name tells of its layout)."""
        n = len(self.parent)
        size = [0] * n
        region = [t in REGION_TAGS and not b for t, b in zip(self.tag, self.by_name, strict=True)]
        for e, text, _ in self.blocks:
            if not self.excluded[e]:
                size[e] += len(text)
        for e in range(n - 1, 0, -1):
            size[self.parent[e]] += size[e]
            if region[e] and not self.excluded[e]:
                region[self.parent[e]] = True
        near, in_region = [0] * n, [False] * n  # innermost named element (0: none); inside a region
        named = [b and not (r and t not in REGION_TAGS) for b, r, t in zip(self.by_name, region, self.tag, strict=True)]
        for e in range(1, n):
            near[e] = e if named[e] else near[self.parent[e]]
            in_region[e] = in_region[self.parent[e]] or (self.tag[e] in REGION_TAGS and not self.by_name[e])
        own = [0] * n  # text of regions and paragraphs by innermost named element
        for e, text, link in self.blocks:
            if not self.excluded[e] and (in_region[e] or self.tag[e] == "p") and link <= LINK_SHARE * len(text):
                own[near[e]] += len(text)
        outside = own[0]
        for e in range(1, n):
            if named[e] and not self.excluded[self.parent[e]]:
                if size[e] > 0.9 * size[0] and not outside:
                    outside += own[e]  # stays: its own paragraphs lie outside the named elements in it
                else:
                    self.excluded[e] = True
            self.excluded[e] = self.excluded[e] or self.excluded[self.parent[e]]


def path_ratios(paths: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Fused ratio of every block: text and punctuation per block of its path, smoothed along the page."""
    kernel = np.array([0.25, 0.5, 0.25])
    _, at, n = np.unique(paths, return_inverse=True, return_counts=True)
    fused = np.ones(len(paths))
    for amount in (length, marks + 1):
        ratio = (np.bincount(at, amount) / n)[at]
        padded = np.pad(ratio, 1, mode="edge")
        fused *= np.convolve(padded, kernel, mode="valid")
    return fused


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    page = Page(source)
    page.settle_names()
    blocks = [(e, t, link) for e, t, link in page.blocks if not page.excluded[e]]
    if not blocks:
        return ""
    element = np.array([e for e, _, _ in blocks])
    paths = np.array([page.path[e] for e in element])
    length = np.array([len(t) for _, t, _ in blocks], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for _, t, _ in blocks], float)
    _, at = np.unique(paths, return_inverse=True)
    linked = np.bincount(at, [min(x, len(t)) for _, t, x in blocks])[at] / np.bincount(at, length)[at]
    menu = (linked > LINK_SHARE) & np.array([page.tag[e] not in ("p", "h1", "h2", "h3", "h4", "h5", "h6")
                                             for e in element])
    fused = path_ratios(paths, length, marks) * ~menu
    core = (fused > 0) & (fused >= SPREAD * fused.std())
    if not core.any():
        return ""
    weight = length * core
    inside = np.zeros(len(page.parent))
    np.add.at(inside, element, weight)
    for e in range(len(page.parent) - 1, 0, -1):
        inside[page.parent[e]] += inside[e]
    total = weight.sum()
    regions = [e for e in range(len(page.parent)) if page.tag[e] in REGION_TAGS and not page.excluded[e] and inside[e] > 0]
    whole = [e for e in regions if inside[e] >= WHOLE_SHARE * total]
    held = np.zeros(len(page.parent), bool)
    held[whole[-1:] or regions] = True  # the innermost region with nearly all of the core, or all regions together
    for e in range(1, len(page.parent)):
        held[e] = held[e] or held[page.parent[e]]
    if weight[held[element]].sum() >= REGION_SHARE * total:
        kept = held[element]
    else:
        where = np.flatnonzero(core)
        first = where[0]
        while first and page.tag[element[first - 1]] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            first -= 1
        kept = np.zeros(len(blocks), bool)
        kept[first:where[-1] + 1] = True
    return " ".join(t for (_, t, _), k, m in zip(blocks, kept, menu, strict=True) if k and not m)


def with_main_text(pages: DataFrame, source: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of column ``source`` added."""
    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        return pa.array([main_text(x) for x in column.to_pylist()], pa.string())

    return pages.withColumn(text, extract(F.coalesce(F.col(source), F.lit(""))))
