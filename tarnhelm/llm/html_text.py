"""Main text of web pages from the events of a streaming parser.

The standard library's parser reads the page once. Its events are gathered into lines: the text between two events
of block elements, with the number of tags met since the line before and the container it is in. What the page itself says
is no text of its - navigation, page headers, footers, asides, forms, scripts, adverts, notices, comments, by element, role or class
word - gives no lines. Each line has its text-to-tag ratio (characters over tags), the ratios are smoothed along the page by a
Gaussian, and a threshold (a share of their standard deviation over the page) parts them into two clusters: the lines above
are content.

The content decides on the region. From the page's root, the search goes down to the container that holds ``SHARE`` of the content's
characters, as long as there is one. A region within an article is the whole article. Any other region grows to its
parent while ``SHARE`` of what the parent adds is content or headings. The region gives all its lines, short ones too, so no
paragraph of an article is dropped; outside of articles, lists and divisions of little content whose text is mostly links are menus
and are left out.

Defined cases: a null or empty page has an empty text, as has one without text. An unclosed comment, tag, script or
style ends with the page; an unclosed element ends with its parent. A page whose classes would leave nothing, as when they name the
whole layout, is read without them. Repeated rows return equal rows. An empty table gives an empty result. Extra columns aren't read.
"""

from __future__ import annotations

import functools
import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces

SIGMA, THRESHOLD, SHARE = 1.0, 0.3, 0.75

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
REGION = frozenset("article main section div td body".split())
#: Containers that are no regions, but can be menus.
LISTS = frozenset("ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER = frozenset("head title script style noscript template nav footer aside form button select textarea iframe object svg math menu dialog input label".split())
ROLES = frozenset("navigation contentinfo complementary search form menu menubar alert dialog alertdialog".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot adunit adsbygoogle sponsor sponsored promo promotion nav navbar topnav sidenav navigation menu breadcrumb breadcrumbs sidebar aside comment comments commentlist disqus cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login".split()
)
#: What is left out around an article, but is its text inside one.
OUTSIDE = frozenset("banner header masthead footer widget related recommended share sharing social reply replies alert subscription search pagination pager toolbar copyright".split())
#: What marks an article or main as none.
NO_ARTICLE = frozenset("ad ads advert adverts advertisement sponsored promo related recommended comment comments reply replies".split())
#: An element closes the open ones named here: HTML lets these end tags out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: A paragraph that is open outside of these is not closed by a block inside.
SCOPE = REGION | LISTS | {"td", "th", "caption", "button"}


@functools.cache
def _implied(tag: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The open elements that a start tag ends, as HTML lets end tags out - a block ends a paragraph, an item the item before it - and those beyond which it ends none."""
    closes = CLOSES.get(tag, set())
    ends = closes | ({"p"} if tag in BLOCK else set())
    return tuple(sorted(ends)), tuple(sorted(SCOPE - closes))


_SPLIT = re.compile(r"[^a-z0-9]+")


class Line(NamedTuple):
    text: str
    tags: int
    container: int
    heading: bool
    linked: int  #: characters inside links


class Container(NamedTuple):
    parent: int
    kind: str
    article: int  #: the innermost article that it is or is in, 0 if none


class Lines(HTMLParser):
    """The lines and containers of a page. Container 0 is the page."""

    def __init__(self, hints: bool = True) -> None:
        super().__init__(convert_charrefs=True)
        self.hints, self.ending = hints, False
        self.lines: list[Line] = []
        self.containers = [Container(0, "body", 0)]
        self.open: list[tuple[str, bool, int]] = []  # name, hidden, container
        self.at: dict[str, list[int]] = defaultdict(list)  # where in ``open`` each name is
        self.text: list[str] = []
        self.tags = self.linked = 0

    def top(self) -> tuple[str, bool, int]:
        return self.open[-1] if self.open else ("", False, 0)

    def last(self, names: Iterable[str]) -> int:
        """Where the innermost open element of ``names`` is, -1 if there is none."""
        return max((at[-1] for n in names if (at := self.at.get(n))), default=-1)

    def shut(self, i: int) -> None:
        """Closes the open elements from i on."""
        for name, _, _ in self.open[i:]:
            self.at[name].pop()
        del self.open[i:]

    def line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append(Line(text, self.tags, self.top()[2], self.last(HEADINGS) >= 0, self.linked))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.line()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        ends, scope = _implied(tag)
        if ends and (i := self.last(ends)) >= 0 and i > self.last(scope):
            self.shut(i)
        _, hidden, container = self.top()
        hidden = hidden or self.never(tag, attrs)
        if tag in REGION or tag in LISTS:
            article = len(self.containers) if tag == "article" else self.containers[container].article
            self.containers.append(Container(container, tag, article))
            container = len(self.containers) - 1
        self.at[tag].append(len(self.open))
        self.open.append((tag, hidden, container))

    def never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        if not attrs and tag != "header":
            return False
        inside = self.last(("article", "main")) >= 0
        if tag == "header" and not inside:
            return True
        for key, value in attrs:
            if key in ("class", "id"):
                hints = NO_ARTICLE if tag in ("article", "main") else frozenset() if not self.hints or tag in ("html", "body") else HINTS if inside else HINTS | OUTSIDE
                if not hints.isdisjoint(_SPLIT.split((value or "").lower())):
                    return True
            elif key == "role" and (value or "").lower() in (ROLES if inside else ROLES | {"banner"}) or key == "hidden" or key == "aria-hidden" and value == "true":
                return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.line()
        self.tags += 1
        i = self.last((tag,))
        if i >= 0 and (tag in ("article", "main", "body", "html") or i > self.last(("article", "main", "body"))):
            self.shut(i)  # but not an end tag without its start inside an article

    def handle_data(self, data: str) -> None:
        if not self.top()[1]:
            self.text.append(data)
            if self.at.get("a"):
                self.linked += len(data.strip())

    def parse_comment(self, i: int, report: bool = True) -> int:
        after = super().parse_comment(i, report)
        return len(self.rawdata) if after < 0 and self.ending else after

    def close(self) -> None:
        self.ending = True
        super().close()
        self.line()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    if not len(ratios):
        return ratios
    reach = max(1, math.ceil(3 * sigma))
    bell = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), bell / bell.sum(), "valid")


def content(lines: list[Line], sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines are in the upper cluster."""
    ratios = smoothed(np.array([len(x.text) / max(1, x.tags) for x in lines]), sigma)
    return ratios >= min(threshold * float(ratios.std()), float(ratios.max()))


def chosen(lines: list[Line], containers: list[Container], good: np.ndarray, share: float = SHARE) -> list[Line]:
    """The lines of the region that the content is in."""
    size = np.array([len(x.text) for x in lines], float)
    own = np.array([x.container for x in lines])
    n, parent = len(containers), [x.parent for x in containers]

    def below(value: np.ndarray) -> list[float]:
        """Of each container, the sum over its lines and those of what it holds, which comes after it."""
        out = np.bincount(own, value, minlength=n).tolist()
        for i in range(n - 1, 0, -1):
            out[parent[i]] += out[i]
        return out

    found, every, fine, links = below(size * good), below(size), below(size * (good | np.array([x.heading for x in lines]))), below(np.array([float(x.linked) for x in lines]))
    region, region_kind = 0, 0
    for i in range(1, n):  # a container comes after its parent, and only one of neighbours has so large a share
        if parent[i] == region and found[i] >= share * found[0] and found[i] > 0:
            region = i
            region_kind = i if containers[i].kind in REGION else region_kind
    region = region_kind
    if article := containers[region].article:
        region = article
    else:
        while region and fine[parent[region]] - fine[region] >= share * (every[parent[region]] - every[region]):
            region = parent[region]
    inside = [False] * n
    menu = [False] * n
    for i in range(n):
        inside[i] = i == region or i > 0 and inside[parent[i]]
        lone = i != region and found[i] <= (1 - share) * every[i] and links[i] >= share * every[i] and not containers[i].article
        menu[i] = i > 0 and inside[parent[i]] and (menu[parent[i]] or lone)
    return [x for x in lines if inside[x.container] and not menu[x.container]]


def extract(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD, hints: bool = True) -> str:
    """The main text: blocks joined by an empty line."""
    if not html:
        return ""
    parser = Lines(hints)
    parser.feed(html)
    parser.close()
    if not parser.lines:
        return extract(html, sigma, threshold, False) if hints else ""
    return "\n\n".join(x.text for x in chosen(parser.lines, parser.containers, content(parser.lines, sigma, threshold)))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "html"):
        texts = [extract(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages``."""
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(_run, "page_id long, url string, text string, n_chars long")
