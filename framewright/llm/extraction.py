"""Main text of web pages by text-to-tag ratios of their lines."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.components import prepare

#: Elements that end the line before and after them.
BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
LEFT_OUT = frozenset(
    "head title script style noscript template nav header footer aside menu button select option textarea "
    "label iframe object svg canvas audio video dialog".split()
)
#: Words of class, id and role that mark an element, whose lines are not main text. Forms are marked too.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie "
    "cookies consent disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter "
    "notice notices notification pager pagination popup promo promotion related replies reply respond share sharing "
    "sidebar sidebars skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets "
    "complementary contentinfo search".split()
)
#: Those that also mark an element in which a page's whole text stands; the others also name layouts and wrappers.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising banner comment comments cookie cookies consent disclaimer "
    "disqus newsletter notice notices notification popup promo promotion replies reply respond sponsor sponsored "
    "subscribe subscription".split()
)
#: What a class word such as has-sidebar begins with: it tells about the page, not about the element.
_TELLING = ("has-", "no-", "with-", "without-")
#: Elements and roles that a page declares as its content.
DECLARED = frozenset(("article", "main"))
_REGIONS = frozenset("article main section div td body".split())
_LISTS = frozenset("ul ol dl table".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_WORD = re.compile(r"[a-z]+")
#: Standard deviation, in lines, of the smoothing, and how far from a line it reaches.
SIGMA = 1.0
REACH = 2
#: Words of a line that count as prose.
PROSE = 10


@dataclass
class Line:
    text: str
    tags: int
    region: int
    part: int  # innermost region or list
    mark: int  # innermost marked element, -1 without
    linked: int  # characters inside links
    heading: bool


def _words(value: str) -> set[str]:
    return {w for name in value.lower().split() if not name.startswith(_TELLING) for w in _WORD.findall(name)}


class Lines(HTMLParser):
    """Collects lines of text, each with the tags it holds and the elements it stands in, from parser events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, int, int, int]] = []  # element, whether left out; what was around it
        self.open: Counter = Counter()
        self.out = 0
        self.regions: list[tuple[int, bool, bool]] = [(-1, False, False)]  # parent, whether declared, whether inside one
        self.region = self.part = self.parts = 0
        self.paragraph = -1  # place on the stack of the innermost open p of the region
        # Marked elements: the marked one around each, whether strongly; strong ones and all, itself and around it.
        self.marks: list[tuple[int, bool, int, int]] = []
        self.mark = -1
        self.outermost: list[tuple[int, int]] = []  # declared regions that stand in none, and their marks
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[Line] = []

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not wanted, so nothing is counted."""
        return j

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            heading = any(self.open[h] for h in _HEADINGS)
            if heading or not self.open["header"]:  # of an article's own header the headlines
                self.lines.append(Line(text, self.tags, self.region, self.part, self.mark, self.linked, heading))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        inside = self.regions[self.region][2]
        left_out, declared = tag in LEFT_OUT and not (tag == "header" and inside), tag in DECLARED
        names: set[str] = {"form"} if tag == "form" else set()
        whole: set[str] = set()
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                names |= _words(value)
                whole |= set(value.lower().split())
                declared |= name == "role" and value in DECLARED
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                left_out = True
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                left_out = True
        names &= MARKS & whole if declared else MARKS
        if tag == "header":
            names.discard("header")
        if tag in BLOCKS and self.paragraph >= 0:  # a block ends an open paragraph of its region
            place = self.paragraph
            while len(self.stack) > place:
                self._pop()
        self.stack.append((tag, left_out, self.region, self.part, self.mark, self.paragraph))
        self.open[tag] += 1
        self.out += left_out
        if names and tag not in ("html", "body"):
            strong = not STRONG.isdisjoint(names)
            above = self.marks[self.mark][2:] if self.mark >= 0 else (0, 0)
            self.marks.append((self.mark, strong, above[0] + strong, above[1] + 1))
            self.mark = len(self.marks) - 1
        if tag in _REGIONS or declared:
            self.regions.append((self.region, declared, declared or inside))
            self.region = len(self.regions) - 1
            self.paragraph = -1
            if declared and not inside and not self.out:
                self.outermost.append((self.region, self.mark))
        if tag in _REGIONS or tag in _LISTS or declared:
            self.parts += 1
            self.part = self.parts
        if tag == "p":
            self.paragraph = len(self.stack) - 1

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        # An end tag closes what is open inside its element; one that no element matches is passed over.
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        tag, left_out, self.region, self.part, self.mark, self.paragraph = self.stack.pop()
        self.open[tag] -= 1
        self.out -= left_out
        return tag

    def handle_data(self, data):
        if not self.out:
            self.text.append(data)
            if self.open["a"]:
                self.linked += len(data.strip())

    def content(self) -> tuple[list[Line], set[int]]:
        """The lines outside marked elements, and the declared regions.

        Of the declared regions those count that stand in the fewest marked elements, strong ones first; the elements
        around them are frames and mark nothing. Declared regions in strongly marked elements do not count beside prose.
        Without any, a weakly marked element with most of the text is a frame where no prose stands outside.
        """
        prose = any(line.mark < 0 and len(line.text.split()) >= PROSE for line in self.lines)
        depth = {region: self.marks[mark][2:] if mark >= 0 else (0, 0) for region, mark in self.outermost}
        least = min(depth.values(), default=(0, 0))
        declared = {r for r, d in depth.items() if d == least and not (least[0] and prose)}
        frames: set[int] = set()
        for region, mark in self.outermost:
            while region in declared and mark >= 0 and mark not in frames:
                frames.add(mark)
                mark = self.marks[mark][0]
        if not declared and not prose:
            held, total = [0] * len(self.marks), sum(len(line.text) for line in self.lines)
            for line in self.lines:
                if line.mark >= 0:
                    held[line.mark] += len(line.text)
            for i in range(len(held) - 1, -1, -1):  # an element comes after the one around it
                outer, strong = self.marks[i][:2]
                if outer >= 0:
                    held[outer] += held[i]
                if 2 * held[i] > total and not strong:
                    frames.add(i)
        marks: list[bool] = []
        for i, (outer, *_) in enumerate(self.marks):
            marks.append(i not in frames or (outer >= 0 and marks[outer]))
        return [x for x in self.lines if x.mark < 0 or not marks[x.mark]], declared


def smooth(values: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the weights are shared among the lines there are."""
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(values)), kernel)[reach:-reach]
    return np.convolve(values, kernel)[reach:-reach] / weight


def content_lines(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to the upper of two clusters, split where the between-cluster variance is largest."""
    smoothed = smooth(ratios)
    order = np.sort(smoothed)
    if order[0] == order[-1]:
        return np.ones(len(ratios), bool)
    n = np.arange(1, len(order))
    below = np.cumsum(order)[:-1]
    above = order.sum() - below
    gap = (above / (len(order) - n) - below / n) ** 2 * n * (len(order) - n)
    gap[order[1:] == order[:-1]] = -1
    return smoothed >= order[int(np.argmax(gap)) + 1]


def main_text(html: str | None) -> str:
    """The main text of one page.

    Lines in marked elements go, whatever their length. The text-to-tag ratios of the others, smoothed, fall into two
    clusters. Regions (articles, divisions and so on) that hold a line of the upper one are kept whole, so that short
    paragraphs between long ones stay; after them, what stands directly beside kept lines: regions of prose
    that is not mostly links, and headings before it.

    Where the page declares articles or a main element, these are the regions: others are not kept, and if none
    of them holds a line of the upper cluster, their own lines are clustered. Inside, a part (division, list and so on)
    without a line of the upper cluster goes if most of its text is links. Of an article's header the headlines count.
    """
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    lines, declared = page.content()
    if not lines:
        return ""
    outer: dict[int, int] = {}

    def root(region: int) -> int:
        """The outermost declared region around a region; if a page has none, the region itself; -1 outside."""
        if region not in outer:
            found, at = -1 if declared else region, region
            while declared and at >= 0:
                found = at if at in declared else found
                at = page.regions[at][0]
            outer[region] = found
        return outer[region]

    roots = np.array([root(x.region) for x in lines])
    lengths = np.array([len(x.text) for x in lines], float)
    linked = np.array([x.linked for x in lines], float)
    ratios = lengths / np.maximum([x.tags for x in lines], 1)
    inside = roots >= 0
    if not inside.any():  # what is declared holds no text
        roots, inside, declared = np.array([x.region for x in lines]), np.ones(len(lines), bool), set()
    upper = content_lines(ratios) & inside
    if not upper.any():
        upper[inside] = content_lines(ratios[inside])
    kept = np.isin(roots, roots[upper])
    parts = np.array([x.part for x in lines])
    size, of = (np.bincount(parts, values, minlength=page.parts + 1) for values in (linked, lengths))
    links = 2 * size > of
    if declared:
        links[parts[upper]] = False
        kept &= ~links[parts]
    else:
        prose = np.array([len(x.text.split()) >= PROSE for x in lines])
        beside = np.isin(roots, roots[prose & ~links[parts]]) & ~links[parts]
        heading = np.array([x.heading for x in lines])
        for order in (range(1, len(lines)), range(len(lines) - 2, -1, -1)):
            step = order.step
            for i in order:
                kept[i] |= kept[i - step] and (beside[i] or (step < 0 and bool(heading[i])))
    return " ".join(x.text for x, k in zip(lines, kept.tolist(), strict=True) if k)


def extract_text(pages: DataFrame, html_column: str = "html", out: str = "text") -> DataFrame:
    """The rows with the main text of their page, read whole.

    A null or empty page and one without main text get an empty string. Broken markup is read as far as
    events come; repeated rows stay; a column named like ``out`` is replaced. Rows are independent: no shuffle.
    """

    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return pages.withColumn(out, text(pages[html_column].cast("string")))


def page_lines(html: str) -> Iterator[tuple[str, float]]:
    """The lines of a page with their ratios, for looking into a page."""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    for line in page.lines:
        yield line.text, len(line.text) / max(line.tags, 1)
