"""HTML extraction: the main text of a page by text-to-tag ratio.

A standard-library parser streams its events into blocks, the lines of the page, each with its
text, the tags seen in it and its container. The text-to-tag ratios of all lines, menus and the like
among them, are smoothed with a Gaussian, and a two-means threshold splits them into content and the
rest. Names of classes and ids are a feature: a line under a name that often, but not always, is
boilerplate counts a third of its ratio. Regions are selected from that. Of article elements (or
main, if there is none) those that hold a content line are taken whole, short lines too, if
together they hold half of the content; teasers of other articles have no such line. Pages without one
keep the lines from the first to the last content line and those of its container, and of
others what isn't mostly links or weakly named. What elements, roles and plain names say to be a menu, header,
footer, sidebar, notice, advert, form or comment is never part of a region.

Work is linear in the page: what a line needs to know of the elements around it is carried on
the parser's stack, and containers are numbered so that those inside one are a range."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
SKIP = frozenset("applet audio button canvas datalist embed head iframe input map noembed noframes noscript object optgroup option script select style svg template textarea title video".split())
BOILER = frozenset("aside dialog footer form header menu nav search".split())
#: A header that belongs to an article has its title; elsewhere it is the site's.
OWN_HEADER = frozenset({"article", "main"})
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of class or id that name boilerplate, matched as whole parts of a name.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|aside|widgets?|footer\w*|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|popup|modal|newsletter|subscribe|signup|login|comments?|commentlist|respond|disqus|pagination|pager|copyright)(?=$|[\s_-])",
    re.I,
)
#: Words that may name boilerplate or a part of the article: a feature of the ratio.
WEAK = re.compile(r"(?:^|[\s_-])(?:side|alerts?|replies|reply|discussion|share|sharing|social\w*|related\w*|recommend\w*|trending|tags|legal|disclaimer)(?=$|[\s_-])", re.I)
WEAK_SHARE = 1 / 3
#: Ratio of the two means of the clustering from which they are two clusters.
APART = 1.5
#: Classes of an inline element that is an advert.
INLINE_ADS = frozenset("ad ads advert advertisement adsbygoogle sponsored".split())
#: Of these, words that also name the frame around a whole page, like `with-sidebar`: an article or main inside is no part of it.
FRAME = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|sidebar\w*|side|aside|widgets?|banner\w*|masthead|topbar|toolbar|header)(?=$|[\s_-])", re.I)
#: Elements whose ids often derive from the words of a heading; of them headings and paragraphs are no containers.
WORDED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
CONTAINERS = BLOCK - (WORDED - {"section"})
#: Whole names that say boilerplate inside an article too: ids, and as classes don't derive from headings, more classes.
OWN_IDS = frozenset("ad ads advert advertisement advertisements share sharing share-buttons share-links social-share comments comment-list commentlist comment-form comments-area comments-section disqus_thread related-posts related-articles newsletter-signup".split())
OWN_CLASSES = OWN_IDS | frozenset("ad-container ad-slot adsense banner-ad breadcrumb breadcrumbs navbar pager pagination popup sidebar sponsored widget newsletter".split())
HEADER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|site-header|page-header)(?=$|[\s_-])", re.I)
#: Opening one of these ends an open p; and what an item of each kind ends.
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li option summary tbody td tfoot th thead tr".split())
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside body div dl footer form header main nav ol section table ul".split())
#: Titles, which may be links to their own page, and containers that are parts of an article rather than around it.
TITLES = frozenset({"h1", "h2"})
PARTS = frozenset("dl ol section table ul".split())
SPACE = re.compile(r"\s+")


class _Open(NamedTuple):
    """An open element and what holds inside it."""

    tag: str
    skipped: bool
    boiler: int  # 1 by a frame's name, 2 else
    weak: bool
    container: int
    article: bool
    link: bool
    title: bool


class _Block(NamedTuple):
    text: str
    tags: int
    container: int
    boiler: bool
    weak: bool
    links: bool


_OUTSIDE = _Open("", False, 0, False, 0, False, False, False)


class _Reader(HTMLParser):
    """Collects the blocks of a page and the tree of containers."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.open: Counter[str] = Counter()
        self.blocks: list[_Block] = []
        self.parents: list[tuple[int, str]] = [(-1, "")]
        self.parts: list[str] = []
        self.tags = 0
        self.linked = 0

    def _top(self) -> _Open:
        return self.stack[-1] if self.stack else _OUTSIDE

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        self.parts = []
        if text:
            top = self._top()
            links = self.linked * 2 >= len(text) and not top.title
            self.blocks.append(_Block(text, self.tags, top.container, top.boiler > 0, top.weak, links))
            self.tags = 0
        self.linked = 0

    def _close(self, at: int) -> None:
        gone = self.stack[at:]
        if any(x.tag in BLOCK for x in gone):
            self._flush()
        self.open.subtract(x.tag for x in gone)
        del self.stack[at:]

    def _close_open(self, names: tuple[str, ...]) -> None:
        if not any(self.open[n] > 0 for n in names):
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in names:
                self._close(i)
                return
            if self.stack[i].tag in SCOPE:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
        elif tag == "hr":
            self._flush()
        if tag in VOID:
            return
        if tag in ENDS_P:
            self._close_open(("p",))
        if tag in ENDS:
            self._close_open(ENDS[tag])
        if tag in BLOCK:
            self._flush()
        top = self._top()
        boiler, container = top.boiler, top.container
        a = {k: v or "" for k, v in attrs}
        names, ids = (a.get("class", ""), a.get("id", "")) if tag in CONTAINERS or tag not in BLOCK else ("", "")
        classes = {x.lower() for x in names.split()}
        if tag not in BLOCK:
            names = ids = ""
        if top.article:
            names = " ".join(x for x in names.split() if x.lower() in OWN_CLASSES)
        if top.article or tag in WORDED:
            ids = " ".join(x for x in ids.split() if x.lower() in OWN_IDS)
        name = f"{names} {ids}"
        own_header = tag == "header" and top.article
        plain = tag not in ("html", "body", "article", "main")
        own = top.article and name != " "
        whole = any(x.lower() in OWN_CLASSES for x in names.split())
        named = plain and (own or whole or bool(NAMES.search(name) or (not top.article and HEADER_NAMES.search(name))))
        weak = top.weak or (plain and not named and WEAK.search(name) is not None)
        if boiler == 1 and tag in OWN_HEADER:
            boiler = 0
        if (tag in BOILER and not own_header) or a.get("role", "").lower() in ROLES or (named and (own or whole or NAMES.search(FRAME.sub(" ", name)))):
            boiler = 2
        elif named:
            boiler = max(boiler, 1)
        if tag in SCOPE:
            self.parents.append((container, tag))
            container = len(self.parents) - 1
        skipped = top.skipped or tag in SKIP or (tag not in BLOCK and not classes.isdisjoint(INLINE_ADS))
        self.stack.append(_Open(tag, skipped, boiler, weak, container, top.article or tag in OWN_HEADER, top.link or tag == "a", top.title or tag in TITLES))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # outside of SVG and the like, the slash of <div/> has no meaning
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append("\n")
            return
        if self.open[tag] <= 0:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self._close(i)
                return
            if tag not in BLOCK and self.stack[i].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        top = self._top()
        if not top.skipped:
            self.parts.append(data)
            if top.link:
                self.linked += len(SPACE.sub(" ", data).strip())


def _smooth(x: list[float], sigma: float) -> list[float]:
    r = max(1, math.ceil(2 * sigma))
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    out = []
    for i in range(len(x)):
        num = den = 0.0
        for j, v in enumerate(w):
            k = i + j - r
            if 0 <= k < len(x):
                num, den = num + v * x[k], den + v
        out.append(num / den)
    return out


def _threshold(x: list[float]) -> float:
    """The middle between the two means that two-means clustering ends with; 0 where they are less
    than APART times apart, which is one cluster."""
    lo, hi = min(x), max(x)
    for _ in range(50):
        cut = (lo + hi) / 2
        a, b = [v for v in x if v <= cut], [v for v in x if v > cut]
        if not b:
            break
        new = sum(a) / len(a), sum(b) / len(b)
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2 if hi >= APART * lo else 0.0


def content_lines(blocks: list[_Block], sigma: float = 1.0) -> tuple[list[float], list[bool], float]:
    """(ratio of each line, whether it is content after smoothing, the threshold)."""
    raw = [0.0 if b.boiler else len(b.text) / max(1, b.tags) * (WEAK_SHARE if b.weak else 1) for b in blocks]
    ratio = _smooth(raw, sigma)
    cut = _threshold(ratio)
    own = [r for r, b in zip(ratio, blocks) if not b.boiler]
    even = not own or max(own) == min(own) or len(own) == 1
    return raw, [not b.boiler and (r > cut or even) for r, b in zip(ratio, blocks)], cut


def main_text(html: str, sigma: float = 1.0) -> str:
    """The article's blocks joined by two newlines; empty if there is none."""
    reader = _Reader()
    reader.feed(html)
    reader.close()
    reader._flush()
    blocks, parents = reader.blocks, reader.parents
    if all(b.boiler for b in blocks):
        return ""
    raw, content, cut = content_lines(blocks, sigma)
    if not any(content):
        content = [not b.boiler for b in blocks]
    # containers are numbered as they open, so those inside one follow it, up to its end
    end = list(range(len(parents)))
    for x in range(len(parents) - 1, 0, -1):
        end[parents[x][0]] = max(end[parents[x][0]], end[x])
    inside = lambda x, b: x <= b.container <= end[x]

    def weigh() -> list[int]:
        """The content characters of each container."""
        weight = [0] * len(parents)
        for b, c in zip(blocks, content):
            weight[b.container] += len(b.text) if c else 0
        for x in range(len(parents) - 1, 0, -1):
            weight[parents[x][0]] += weight[x]
        return weight

    weight = weigh()
    for kind in ("article", "main"):
        outermost, last = [], -1
        for x, (_, tag) in enumerate(parents):
            if tag == kind and x > last:
                last = end[x]
                outermost += [x] if weight[x] else []
        if outermost and sum(weight[x] for x in outermost) * 2 >= weight[0]:
            return "\n\n".join(b.text for b in blocks if not b.boiler and any(inside(x, b) for x in outermost[max(0, bisect_right(outermost, b.container) - 1) :][:1]))
    # no such element: links that only their neighbours' text lifts over the threshold are no content
    own = [c and (not b.links or r > cut) for b, c, r in zip(blocks, content, raw)]
    content = own if any(own) else content
    weight = weigh()
    # the container of all content, or of most of it where that is the page, has its links too
    best = max(x for x in range(len(parents)) if weight[x] == weight[0])
    while parents[best][1] in PARTS:
        best = parents[best][0]
    if parents[best][1] in ("", "body"):
        best = max(x for x in range(len(parents)) if weight[x] * 10 >= weight[0] * 7)
    first, last = content.index(True), len(content) - 1 - content[::-1].index(True)
    return "\n\n".join(b.text for i, b in enumerate(blocks) if not b.boiler and (first <= i <= last or inside(best, b) or not (b.links or b.weak)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    text is the main text, blocks in page order joined by two newlines; null, empty and
    text-less pages give an empty text of 0 characters. Rows repeat as the input does, an
    empty table gives none, other columns don't matter."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
