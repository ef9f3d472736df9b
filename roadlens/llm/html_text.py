"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold.

The parser's events are cut into lines at block elements. A line's ratio is its
text over its tags; the ratios are smoothed with a Gaussian, and the lines above a
threshold are content. Where they stand decides what is kept: the article and main
elements that have some or, without one, the stretch from the first to the last.
Out of that go lines of link lists, whose own ratio is below the page's mean, and
at the ends of a stretch single links and copyright lines.

Elements that HTML itself keeps apart (nav, aside, form, roles and the like) are
never content. Class names and ids only tip it: a named element stays if it holds
most of the content of a page that has no article elsewhere, or if it is named as
links usually are and holds prose instead.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIP = frozenset("aside audio button canvas dialog footer form head iframe map menu nav noscript object option script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split())
#: Of those, names of what readers write, and of what mostly holds links.
READERS = frozenset("comment comments disqus reply respond".split())
LINKS = frozenset("breadcrumb breadcrumbs header masthead menu nav navbar navigation pager pagination share sharing skip social toolbar widget widgets".split())
HEADINGS = ("h1", "h2")
SIGMA, SPREAD = 1.5, 0.5
#: So much of a line in links makes it one; so many in a row are a list.
LINKED, LINK_RUN = 0.8, 3
_LEGAL = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_NAME = re.compile(r"(?:has|with|no)[-_][a-z]+|[a-z]+")


class Line(NamedTuple):
    text: str
    tags: int
    container: int  # number of the article or main element, 0 for none
    named: int  # number of the innermost element with a name of chrome, 0 for none
    links: int  # characters in links
    heading: bool


class Open(NamedTuple):
    tag: str
    skip: bool
    container: int
    named: int


ROOT = Open("", False, 0, 0)


class Lines(HTMLParser):
    """The lines of a page, but for elements that are never content, and its named elements: the one around each, and its names."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = []
        self.count: Counter[str] = Counter()  # of open elements, by name
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.named: list[tuple[int, frozenset[str]]] = [(0, frozenset())]
        self.tags = self.containers = 0

    @property
    def top(self) -> Open:
        return self.open[-1] if self.open else ROOT

    def shut(self, k: int) -> None:
        """Closes the open elements from number k on."""
        self.count.subtract(x.tag for x in self.open[k:])
        del self.open[k:]

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            links = len(" ".join("".join(self.linked).split()))
            self.lines.append(Line(text, max(1, self.tags), self.top.container, self.top.named, links, self.top.tag in HEADINGS))
            self.tags = 0
        self.parts.clear()
        self.linked.clear()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
            for k in range(len(self.open) - 1, -1, -1) if self.count["p"] > 0 else ():  # a block ends an open paragraph
                if self.open[k].tag == "p":
                    self.shut(k)
                    break
                if self.open[k].tag in BLOCK:
                    break
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag == self.top.tag == "a":  # links don't nest
            self.shut(len(self.open) - 1)
        _, skip, container, named = self.top
        known = dict(attrs) if attrs else {}
        if tag in ("html", "body"):
            skip = False
        elif not skip:
            skip = tag in SKIP or (tag == "header" and not container) or bool(known) and self.apart(known)
            names = self.names(tag, known, container) if known and not skip else frozenset()
            if names:
                self.named.append((named, names))
                named = len(self.named) - 1
        if tag in ("article", "main") and not container and not skip:
            self.containers += 1
            container = self.containers
        self.open.append(Open(tag, skip, container, named))
        self.count[tag] += 1

    @staticmethod
    def apart(attrs: dict) -> bool:
        """Hidden, or of a role that is never content."""
        if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I):
            return True
        return (attrs.get("role") or "").lower() in ROLES

    @staticmethod
    def names(tag: str, attrs: dict, container: int) -> frozenset[str]:
        names = frozenset(_NAME.findall(f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()))
        if tag in ("article", "main"):
            return frozenset()
        return names & (NAMES if container else NAMES | {"header"})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if self.count[tag] <= 0:  # nothing of that name is open
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                self.shut(k)
                break

    def handle_data(self, data):
        if not self.top.skip:
            self.parts.append(data)
            if self.count["a"] > 0:
                self.linked.append(data)

    def close(self):
        if _UNFINISHED.match(self.rawdata):  # a tag or comment that the page breaks off in
            self.rawdata = ""
        super().close()
        self.flush()


def smooth(x: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def chrome(lines: list[Line], named: list[tuple[int, frozenset[str]]], weight: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Which lines are in a named element that isn't content after all; weight: characters of a line, if it is content."""
    own = np.array([x.named for x in lines])
    size, held, prose = (np.bincount(own, weights=w, minlength=len(named)) for w in (np.array([len(x.text) for x in lines], float), weight, weight * ~linked))
    for k in range(len(named) - 1, 0, -1):  # an element's number is larger than that of the one around it
        around = named[k][0]
        size[around], held[around], prose[around] = size[around] + size[k], held[around] + held[k], prose[around] + prose[k]
    elsewhere = any(x.container and not x.named and w > 0 for x, w in zip(lines, weight.tolist(), strict=True))
    out = np.zeros(len(named), bool)
    for k in range(1, len(named)):
        around, names = named[k]
        most = not elsewhere and not names & READERS and 2 * held[k] > held[0]
        out[k] = out[around] or not (most or names <= LINKS and 2 * prose[k] > size[k])
    return out[own]


def in_lists(linked: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Lines in runs of links that have less text to a tag than is usual on the page."""
    some = np.flatnonzero(linked & short)
    runs = np.split(some, np.flatnonzero(np.diff(some) > 1) + 1)
    out = np.zeros(len(linked), bool)
    for run in runs:
        out[run] = len(run) >= LINK_RUN
    return out


def main_text(html: str) -> str:
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    size = np.array([len(x.text) for x in lines], float)
    alone = size / np.array([x.tags for x in lines])
    ratio = smooth(alone)
    threshold = min(SPREAD * ratio.std(), ratio.max())
    content = ratio >= threshold
    short = alone < alone.mean()
    linked = np.array([x.links for x in lines]) >= LINKED * size
    keep = ~chrome(lines, parser.named, size * content, linked)
    if not keep.any():
        return ""
    content &= keep
    inside = np.array([x.container for x in lines])
    weight = np.bincount(inside, weights=size * content)
    if len(weight) > 1 and weight[1:].max() > 0 and weight[1:].max() >= weight[0]:
        # a container that begins with a link may be the teaser of another page
        known, at = np.unique(inside, return_index=True)
        teaser = np.zeros(len(weight), bool)
        teaser[known] = linked[at]
        chosen = (weight > 0) & (~teaser | (2 * weight >= weight[1:].max()))
        chosen[0] = False
        within = chosen[inside]
        begin = int(np.argmax(within))
        title = begin > 0 and lines[begin - 1].heading and keep[begin - 1] and not linked[begin - 1] and not inside[begin - 1]
        keep &= within
        if title:
            keep[begin - 1] = True
    elif content.any():
        at = np.flatnonzero(content & ~(linked & short))
        at = at if len(at) else np.flatnonzero(content)
        begin, end = at[0], at[-1]
        while end > begin and short[end] and (linked[end] or _LEGAL.match(lines[end].text)):
            end -= 1
        keep[:begin] = keep[end + 1 :] = False
    keep &= ~in_lists(linked, short)
    return "\n".join(x.text for x, k in zip(lines, keep.tolist(), strict=True) if k)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html).

    Null or empty html, and pages without content, give an empty text. Ids and
    urls are passed on, null or repeated; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
