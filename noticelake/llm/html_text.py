"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clusters.

``html.parser`` reads a page once and sends its events to ``PageLines``, which keeps the
page's lines: the texts of its blocks, each with the number of tags since the line before.
Lines in parts that are no article by their element, role or name (menus, forms, reader
comments, ...) count as lines without text. The ratios of text to tags are smoothed over
neighbouring lines, and lines at or above the standard deviation of the smoothed ratios form
the clusters of content.

A content region is then the element that the clusters lie in: the ``article`` (or ``main``)
with the most of their text, and without one the innermost element that holds most of it.
All lines of a region belong to the text, short ones as well, so an article's one-word
paragraphs stay. Where a region is no ``article`` or ``main``, lines of links alone do not
belong, and where it is the whole page, what is outside of the clusters and of the
paragraphs and headings that they go on in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticelake.llm.common import text_or_empty

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Elements within a line; all others begin and end one.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)

#: Elements whose text is no part of an article, wherever they are.
APART = frozenset("aside button dialog datalist embed footer form head iframe input menu nav noscript object optgroup option script select style svg template textarea title".split())

#: Roles of the same kind.
APART_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

#: Words in the class or id of the same kind.
APART_WORDS = frozenset(
    """ad ads adsense advert adverts advertisement advertisements advertising alert alerts aside banner billboard breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies copyright disclaimer discussion disqus footer form forms gdpr login masthead menu menus modal nav navbar navigation navi newsletter notice notices notification
    notifications overlay pager pagination paywall popup promo promoted promotion rail recommendations recommended related replies respond search share sharing sidebar sidebars
    signin signup skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets""".split()
)

#: Beginnings and ends of names that are written as one word.
APART_PIECES = ("advert", "breadcrumb", "comments", "commentform", "cookie", "footer", "masthead", "menu", "navbar", "newsletter", "sidebar", "sponsor", "subscribe")

#: As above, but common in names of headings and of an article's own parts.
HEADER_WORDS = frozenset(("header", "head"))

#: Words after which a name says what is or is not beside an element.
ABOUT_OTHERS = frozenset(("has", "no", "not", "with", "without"))

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: An opening tag of the first kind ends open elements of the second, up to one of the third.
ENDS = {
    **dict.fromkeys(("li",), (("li",), ("ul", "ol", "menu", "dir"))),
    **dict.fromkeys(("dt", "dd"), (("dt", "dd"), ("dl",))),
    **dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table"))),
    **dict.fromkeys(("tr",), (("tr",), ("table", "thead", "tbody", "tfoot"))),
    **dict.fromkeys(("option",), (("option",), ("select", "datalist"))),
}

#: Lines to either side that weigh in a smoothed ratio, and the width of the bell.
REACH, SIGMA = 2, 1.0
#: Share of the clusters' text that an element must hold for the region to go down into it.
HOLDS = 0.7
#: Share of linked characters from which a line is one of links.
LINKED = 0.6

_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")


@dataclass
class Line:
    text: str
    tags: int
    linked: int
    element: int


@dataclass
class PageLines(HTMLParser):
    """Lines and elements of a page. An element is its tag, its parent and what is said of it; 0 is the page itself."""

    lines: list[Line] = field(default_factory=list)
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    named: list[str] = field(default_factory=lambda: [""])

    def __post_init__(self):
        super().__init__(convert_charrefs=True)
        self._open, self._counts = [0], {}
        self._pieces: list[str] = []
        self._seen = self._linked = self._quiet = self._links = 0

    def parse_comment(self, i, report=1):
        """A comment that never ends takes the rest of the page, as in a browser."""
        end = self.rawdata.find("-->", i + 2)
        return len(self.rawdata) if end < 0 else end + 3

    def _line(self) -> None:
        text = " ".join("".join(self._pieces).split())
        if text:
            block = next(e for e in reversed(self._open) if self.tags[e] not in INLINE)
            self.lines.append(Line(text, self._seen, self._linked, block))
            self._seen = 0
        self._pieces, self._linked = [], 0

    def _close(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        for e in self._open[depth:]:
            tag = self.tags[e]
            self._counts[tag] -= 1
            self._quiet -= tag in ("script", "style")
            self._links -= tag == "a"
        del self._open[depth:]

    def _last(self, wanted: tuple[str, ...], until: tuple[str, ...] | frozenset[str] = ()) -> int:
        """Where the innermost open element of the wanted kinds is, if none of the other kinds is within it; 0 if there is none."""
        if any(self._counts.get(t) for t in wanted):
            for depth in range(len(self._open) - 1, 0, -1):
                tag = self.tags[self._open[depth]]
                if tag in wanted:
                    return depth
                if tag in until:
                    return 0
        return 0

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._line()
            if depth := self._last(("p", *HEADINGS), BOXES):
                self._close(depth)
            if tag in ENDS and (depth := self._last(*ENDS[tag])):
                self._close(depth)
        self._seen += 1
        if tag in VOID:
            if tag == "br":
                self._pieces.append(" ")
            return
        about = dict(attrs)
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.named.append("\0" if _hidden(about) else " ".join(about.get(k) or "" for k in ("role", "class", "id")) if about else "")
        self._open.append(len(self.tags) - 1)
        self._counts[tag] = self._counts.get(tag, 0) + 1
        self._quiet += tag in ("script", "style")
        self._links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ("path", "g", "circle", "rect", "use"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._line()
        self._seen += 1
        if depth := self._last((tag,), BOXES if tag in INLINE or tag == "p" else ()):
            self._close(depth)

    def handle_data(self, data):
        if not self._quiet:
            self._pieces.append(data)
            if self._links:
                self._linked += len(data)

    def close(self):
        if re.match("<[a-zA-Z/!?]", self.rawdata):  # the page ends within a tag
            self.rawdata = ""
        super().close()
        self._line()


#: Elements that a paragraph or an inline element does not reach out of.
BOXES = frozenset(("article", "aside", "blockquote", "body", "center", "dd", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "html", "li", "main", "nav", "ol", "section", "table", "td", "th", "ul"))


def _hidden(about: dict[str, str | None]) -> bool:
    style = (about.get("style") or "").replace(" ", "").lower()
    return "hidden" in about or about.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _says(named: str, words: frozenset[str]) -> bool:
    """Whether a role, class or id has one of the words, other than to tell of what is beside the element."""
    for name in named.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        if parts and parts[0] not in ABOUT_OTHERS and any(w in words or words is APART_WORDS and (w.startswith(APART_PIECES) or w.endswith(APART_PIECES)) for w in parts):
            return True
    return False


def _is_apart(tag: str, named: str, in_article: bool) -> bool:
    """Whether an element is no part of an article by what it is called."""
    if tag in APART or named == "\0":
        return True
    if tag == "header" and not in_article:
        return True
    if not named or tag in ("html", "body", "main"):
        return False
    if named.split(" ")[0] in APART_ROLES:
        return True
    if _says(named, APART_WORDS):
        return True
    return tag not in HEADINGS and tag != "article" and not in_article and _says(named, HEADER_WORDS)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Each ratio weighed with its neighbours by a bell curve; at the ends by those that there are."""
    bell = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    weighed, weights = np.convolve(ratios, bell), np.convolve(np.ones(len(ratios)), bell)
    return weighed[REACH : REACH + len(ratios)] / weights[REACH : REACH + len(ratios)]


def clusters(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: those whose smoothed ratio reaches the standard deviation, and that have text."""
    if not ratios.any():
        return np.zeros(len(ratios), bool)
    even = smoothed(ratios)
    return (even >= min(even.std(), even.max())) & (ratios > 0)


def content_lines(page: PageLines) -> list[Line]:
    """The lines of the content region, in page order."""
    n = len(page.tags)
    article, apart = [False] * n, [False] * n  # within an article or main; within a part that is none
    holds = [False] * n  # has an article within it
    own = [False] * n
    for e in range(1, n):
        tag, up = page.tags[e], page.parents[e]
        own[e] = _is_apart(tag, page.named[e], article[up])
        article[e] = article[up] or tag in ("article", "main")
        apart[e] = apart[up] or own[e]
    if not any(page.tags[e] in ("article", "main") and not apart[e] for e in range(n)):
        # a form or a badly named part round the whole article is no reason to leave it out
        for e in range(n - 1, 0, -1):
            inside = holds[e] or page.tags[e] in ("article", "main") and not own[e]
            holds[page.parents[e]] = holds[page.parents[e]] or inside
        fixed = ("nav", "aside", "footer", "head", "script", "style", "template", "noscript")
        for e in range(1, n):
            apart[e] = apart[page.parents[e]] or own[e] and not (holds[e] and page.tags[e] not in fixed)
    free = [not apart[x.element] for x in page.lines]
    ratios = np.array([len(x.text) / max(1, x.tags) if f else 0.0 for x, f in zip(page.lines, free, strict=True)])
    chosen = clusters(ratios)

    def masses(of) -> list[int]:
        total = [0] * n
        for k, x in enumerate(page.lines):
            if of[k]:
                total[x.element] += len(x.text)
        for e in range(n - 1, 0, -1):
            total[page.parents[e]] += total[e]
        return total

    mass, text = masses(chosen), masses(free)
    region = 0
    for kind in ("article", "main"):
        found = [e for e in range(n) if page.tags[e] == kind and not apart[e] and text[e]]
        if found:
            region = max(found, key=lambda e: (mass[e], text[e], -e))
            # an article within another is a reader's, unless it has most of the text
            inner = [e for e in found if e != region and _inside(page, [region])[e]]
            if inner and 2 * text[most := max(inner, key=lambda e: (text[e], -e))] > text[region]:
                region, inner = most, [e for e in inner if e != most and _inside(page, [most])[e]]
            inside, others = _inside(page, [region]), _inside(page, inner)
            return [x for x, f in zip(page.lines, free, strict=True) if f and inside[x.element] and not others[x.element]]
    below: dict[int, list[int]] = {}
    for e in range(1, n):
        if mass[e] and page.tags[e] not in INLINE and page.tags[e] not in HEADINGS and page.tags[e] not in ("p", "li", "pre", "tr", "td"):
            below.setdefault(page.parents[e], []).append(e)
    while below.get(region) and mass[best := max(below[region], key=lambda e: mass[e])] >= HOLDS * mass[region]:
        region = best
    inside = _inside(page, [region])
    at = [k for k, x in enumerate(page.lines) if chosen[k] and inside[x.element]]
    if not at:
        return []
    first, last = at[0], at[-1]
    beside = {page.parents[page.lines[k].element] for k in at}

    def goes_on(k: int) -> bool:
        """Whether a line next to the clusters is of their kind: anything in a region of its own, a paragraph or heading beside them on a bare page."""
        if not 0 <= k < len(page.lines) or not free[k] or not inside[e := page.lines[k].element]:
            return False
        return page.tags[region] not in ("", "html", "body") or page.parents[e] in beside and (page.tags[e] in HEADINGS or page.tags[e] in ("p", "pre", "blockquote", "li"))

    while goes_on(first - 1):
        first -= 1
    while goes_on(last + 1):
        last += 1
    return [x for k, x in enumerate(page.lines) if first <= k <= last and free[k] and inside[x.element] and (chosen[k] or x.linked < LINKED * len(x.text))]


def _inside(page: PageLines, outer: list[int]) -> list[bool]:
    """Whether each element is one of the outer ones or within one; an element's number is above its parent's."""
    inside = [False] * len(page.tags)
    for e in outer:
        inside[e] = True
    for e in range(1, len(inside)):
        inside[e] = inside[e] or inside[page.parents[e]]
    return inside


def main_text(html: str | None) -> str:
    """The main text of a page, a line for each block; empty without one."""
    if not html:
        return ""
    page = PageLines()
    page.feed(html)
    page.close()
    return "\n".join(x.text for x in content_lines(page))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            texts = pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), texts], ["id", "url", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: (id_col, url_col, text, n_chars long).

    ``text`` is the main text of the page, decoded, with one space for white space inside a
    block (a line break included) and a line feed between blocks; empty, never null, where
    the page is null, empty or has no main text. ``n_chars`` counts its code points. Null and
    repeated ids and urls keep their rows; other columns are not read. A page is read whole,
    however long. An empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    found = rows.mapInArrow(_extract, "id long, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
