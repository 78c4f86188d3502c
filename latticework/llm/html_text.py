"""Main text of web pages from text-to-tag ratios over parser events.

One streaming pass of the standard library's parser turns a page into lines, one per block of
text, each with its characters, its tags and the region (the container) it stands in.  The ratio
of characters to tags per line is smoothed with a Gaussian and split in two clusters by an
iterated threshold.  Regions with a line that is above it, smoothed and by itself, are content and are kept whole, so that their
short paragraphs stay, but for runs of lines below it that are links throughout (a menu).

Elements only mark candidates.  What the contract names (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) is told by element, role and class
word and is none; its lines still count among the ratios.  Where a page has articles, or else a
main element, these are the candidates; otherwise every container is.  If no candidate has a line
above the threshold (a very short text), the one with the largest smoothed ratio is taken.

Character references are decoded, white space inside a block becomes one space, blocks are
joined by a line break.

Defined results: null and empty pages, and pages without text outside boilerplate, give an empty
text.  An element with an optional end tag ends where its next sibling or its parent does.  A
boilerplate element that is never closed may have swallowed the page: its lines are candidates
like any other, and the ratios decide.  A declaration that the parser refuses is passed over.
Repeated rows have equal results; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, picked, text_blocks

SIGMA = 1.0
BLOCK = 1 << 20
SCHEMA = "page_id long, url string, text string, n_chars long"

# Elements that begin a new block of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre script section select style "
    "summary table tbody td template textarea tfoot th thead title tr ul video audio canvas object svg math".split()
)
# Elements whose content is never main text.
SKIPPED = frozenset("nav footer aside form script style noscript template head title iframe button select option textarea menu dialog svg math canvas object audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in class and id that mark what the contract leaves out, and roles that do.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsored cookie cookies consent notice notices sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments replies".split()
)
HEADERS = frozenset(["header", "masthead"])
ROLES = frozenset("navigation banner complementary contentinfo search alert dialog form menu menubar".split())
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
REGIONS = frozenset("article main section div td body".split())
# Elements whose end tag may be left out, with the siblings that end them; "" is any block.
IMPLIED = {"p": "", "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option optgroup", "td": "td th tr tbody tfoot", "th": "td th tr tbody tfoot"}
MENU_LINES = 3
WORDS = re.compile(r"[a-z]+")


@dataclass
class Line:
    region: int
    mark: int  # the innermost boilerplate element, -1: none
    tags: int
    links: int  # characters inside links
    heading: bool
    text: str


class Lines(HTMLParser):
    """Collects a :class:`Line` per block of text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = ["page"]  # of each region
        self.marks: list[list] = []  # of each boilerplate element: the one around it, whether it was closed
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, and what held outside: region, mark, only headings
        self.region, self.mark, self.heading_only = 0, -1, False
        self.within: Counter[str] = Counter()  # elements of the stack by tag
        self.held: list[str] = []
        self.tags = self.links = self.in_link = 0
        self.heading = ""
        self.line_heading = False

    def flush(self) -> None:
        if self.held:
            text = " ".join("".join(self.held).split())
            if text:
                self.lines.append(Line(self.region, self.mark, self.tags, self.links, self.line_heading, text))
            self.held = []
        self.tags = self.links = 0
        self.line_heading = False

    def marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in SKIPPED:
            return True
        if tag in ("body", "html", "article", "main"):
            return False
        for name, value in attrs:
            if name in ("class", "id") and value:
                words = WORDS.findall(value.lower())
                if not MARKED.isdisjoint(words) or (not HEADERS.isdisjoint(words) and not self.within["article"] and not self.within["main"]):
                    return True
            elif name == "role" and value and value.lower() in ROLES:
                return True
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True
        return tag == "header" and not self.within["article"] and not self.within["main"]

    def leave(self, k: int, closed: bool) -> None:
        """Leave the elements of the stack from the ``k``-th on; the ``k``-th was ``closed``."""
        self.flush()
        for i in range(len(self.stack) - 1, k - 1, -1):
            tag, region, mark, only = self.stack[i]
            if mark != self.mark:
                self.marks[self.mark][1] = (closed and i == k) or tag in IMPLIED
            self.region, self.mark, self.heading_only = region, mark, only
            self.within[tag] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            for k in range(len(self.stack) - 1, -1, -1):
                own = self.stack[k][0]
                if own in IMPLIED:
                    if not IMPLIED[own] or tag in IMPLIED[own].split():
                        self.leave(k, True)
                        break
                elif own in REGIONS or own in SKIPPED:
                    break
        self.tags += 1
        if tag in ("br", "img"):
            self.held.append(" ")
        elif tag == "a":
            self.in_link = 1
        elif tag in HEADINGS:
            self.heading = tag
        if tag in VOID:
            return
        skip = self.marked(tag, attrs)
        only = tag == "header" and not skip
        if not (skip or only or tag in REGIONS or tag in IMPLIED):
            return
        self.stack.append((tag, self.region, self.mark, self.heading_only))
        self.heading_only = self.heading_only or only
        if skip:
            self.marks.append([self.mark, False])
            self.mark = len(self.marks) - 1
        if (tag in REGIONS or skip) and not self.within["article"] and (tag == "article" or not self.within["main"]):
            self.kinds.append(tag)
            self.region = len(self.kinds) - 1
        self.within[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element that is not void

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        elif tag in HEADINGS:
            self.heading = ""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.leave(k, True)
                return

    def handle_data(self, data: str) -> None:
        if not self.heading_only or self.heading:
            self.held.append(data)
            self.line_heading = self.line_heading or bool(self.heading)
            self.links += self.in_link * len(data.strip())

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section, of whatever kind, is passed over up to its end."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def left_out(self, mark: int) -> bool:
        """Whether a boilerplate element around a line was closed."""
        while mark >= 0:
            mark, closed = self.marks[mark]
            if closed:
                return True
        return False


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the weights at the ends are renormalised."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def two_clusters(values: np.ndarray) -> float:
    """Threshold midway between the means of the two clusters it makes, by iteration."""
    at = float(values.mean())
    for _ in range(50):
        high, low = values[values >= at], values[values < at]
        if not len(low) or not len(high):
            break
        step = (float(high.mean()) + float(low.mean())) / 2
        if abs(step - at) < 1e-9:
            break
        at = step
    return at


def page_lines(html: str) -> Lines:
    """The lines of a page; markup that the parser refuses is passed over."""
    parser = Lines()
    rest = html
    while True:
        try:
            parser.feed(rest)
            parser.close()
            break
        except AssertionError:  # a declaration that it can't read: go on behind its first character
            rest, parser.rawdata = parser.rawdata, ""
            at = rest.find("<!")
            rest = rest[at + 2 :] if at >= 0 else ""
    parser.leave(0, False)
    return parser


def main_text(html: str | None, threshold: Callable[[np.ndarray], float] = two_clusters) -> str:
    if not html:
        return ""
    parser = page_lines(html)
    lines = parser.lines
    if not lines:
        return ""
    ratios = np.array([len(x.text) / max(1, x.tags) for x in lines])
    smoothed = smooth(ratios)
    at = min(threshold(smoothed), float(smoothed.max()))
    content = smoothed >= at
    usable = [not parser.left_out(x.mark) for x in lines]
    kinds = {parser.kinds[x.region] for x, u in zip(lines, usable, strict=True) if u}
    wanted = "article" if "article" in kinds else "main" if "main" in kinds else None
    candidates = [i for i, x in enumerate(lines) if usable[i] and wanted in (None, parser.kinds[x.region])]
    if not candidates:
        return ""
    # A line that only its neighbours lift above the threshold does not choose its region.
    chosen = {lines[i].region for i in candidates if content[i] and ratios[i] >= at} or {lines[max(candidates, key=lambda i: (smoothed[i], -i))].region}
    kept = [i for i in candidates if lines[i].region in chosen]
    if wanted is None:  # a heading right above a chosen region is that region's
        above = [i - 1 for i in kept if i and lines[i - 1].heading and usable[i - 1] and lines[i - 1].region not in chosen]
        kept = sorted({*kept, *above})
    menus: set[int] = set()
    run: list[int] = []
    for i in [*kept, -1]:
        if i >= 0 and not content[i] and lines[i].links >= 0.9 * len(lines[i].text):
            run.append(i)
            continue
        if len(run) >= MENU_LINES and len(run) < len(kept):
            menus.update(run)
        run = []
    return "\n".join(lines[i].text for i in kept if i not in menus)


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_blocks(batch, BLOCK, "html"):
            texts = [main_text(h.as_py()) for h in part.column("html")]
            columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""
    base = picked(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return arrow(base, _extract_batches, SCHEMA)
