"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events.  They are cut into lines (one per
block of text), each with its text, its number of tags and its place in the
element tree.  A line's ratio is its characters over its tags; ratios are
smoothed with a Gaussian kernel, and lines at or above the threshold (one
standard deviation) are content.  Content lines decide the region: the
``article`` or ``main`` elements that hold them, or else the smallest element
that holds most of their text.  Every line of the region is kept, short ones
too, except those inside boilerplate elements (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) and lists of links.

A class, an id or a form only marks an element.  Content is first found as if
no element was marked; where the marks would leave less than ``CLEAN_SHARE`` of
its text, they are dropped from the outermost element with most of it inwards
(reader comments last, and only if nothing else is left).

Defined results: null, empty and text-free pages give an empty string; markup
that is cut off or badly nested is read as far as it goes; white space (as
Python's ``str.split`` sees it) inside a block becomes one space; repeated rows
give repeated results.  One page is one row: a very long page is bounded by
the memory of one task; an empty table gives no rows; columns beside id, url and
html are not read, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from neurotab.llm.common import map_batches

RADIUS = 2  # of the Gaussian kernel, in lines
LAMBDA = 1.0  # threshold in standard deviations
REGION_SHARE = 0.75
LINK_SHARE = 0.8
CLEAN_SHARE = 0.1

# HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead title tr ul".split())
SILENT = frozenset(
    "head title script style noscript template button select option textarea input iframe object svg math canvas audio video map "
    "datalist dialog nav aside footer menu".split())
MARKED = frozenset("form fieldset".split())
CLOSES_P = BLOCKS - {"option", "title"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
              "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist "
    "alert consent cookie cookies copyright disclaimer discussion disqus footer gdpr login menu menus modal nav navbar navigation newsletter notice "
    "notices notification overlay pager pagination popup promo promotion recommended related respond reply replies share sharing "
    "sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
HEADERS = frozenset("header masthead topbar".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus respond reply replies".split())
NO, MARK, READERS, YES = range(4)  # is it boilerplate: no, by its name (of reader comments: the whole name), for certain
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Lines(HTMLParser):
    """Streams a page into ``lines``: [text parts, tags, link characters, element number, silent]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parents, self.names = [-1], ["#root"]
        self.marks: dict[int, int] = {}
        # (tag, element number, silent, mute): silent text counts as a line without content, mute text is not read
        self.stack: list[tuple[str, int, bool, int]] = [("#root", 0, False, NO)]
        self.owner = (0, False)
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.link_chars = self.links = 0

    def cut(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append([text, self.tags, self.link_chars, *self.owner])
            self.tags = 0
        self.parts, self.link_chars = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br" and self.parts:
            self.parts.append(" ")
        if tag == "body" or tag in BLOCKS - {"title", "html"}:
            if self.stack[-1][3]:  # an unclosed head ends where the body begins
                self.close_to("head", {"noscript", "template", "svg", "select", "button"})
        if tag in BLOCKS:
            self.cut()
            if tag in CLOSES_P and any(x[0] == "p" for x in self.stack[-8:]):
                self.close_to("p", {"table", "td", "th", "button", "article", "section", "div"})
            for name in SAME_LEVEL.get(tag, ()):
                self.close_to(name, SCOPE[tag])
        if tag in VOID:
            return
        _, element, silent, mute = self.stack[-1]
        found = YES if tag in SILENT else self.is_boilerplate(tag, attrs)
        if tag in BLOCKS:
            silent = silent or found == YES
            self.parents.append(element)
            self.names.append(tag)
            element = len(self.names) - 1
            if mute < YES:  # a block in a marked span is a marked block
                found, mute = max(found, mute), NO
            if found in (MARK, READERS):
                self.marks[element] = found
        else:  # scripts, styles, marked spans: a line goes on after them
            mute = max(mute, found)
        self.stack.append((tag, element, silent, mute))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        # only void and foreign elements may end at once; <div/> is an open div
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        self.close_to(tag, set() if tag in BLOCKS else BLOCKS)

    def close_to(self, tag: str, barrier: set) -> None:
        """Close the innermost open ``tag``, unless a barrier stands before it."""
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                self.links -= sum(x[0] == "a" for x in self.stack[k:])
                del self.stack[k:]
                return
            if name in barrier:
                return

    def handle_data(self, data: str) -> None:
        _, element, silent, mute = self.stack[-1]
        if mute:
            return
        if not self.parts:
            self.owner = (element, silent)
        self.parts.append(data)
        if self.links:
            self.link_chars += len(data)

    def is_boilerplate(self, tag: str, attrs: list) -> int:
        inside = any(x[0] in ("article", "main") for x in self.stack)
        if tag == "header" and not inside:
            return YES
        if tag in ("html", "body", "article", "main"):
            return NO
        found = MARK if tag in MARKED else NO
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return YES
            if not value:
                continue
            if name == "role" and value.strip().lower() in ROLES:
                if value.strip().lower() != "form":
                    return YES
                found = max(found, MARK)
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return YES
            if name in ("class", "id") and tag in BLOCKS | {"span", "a"}:
                tokens = {t.lower() for t in TOKEN.findall(value)}
                if tokens & COMMENTS and any("".join(TOKEN.findall(x)).lower() in COMMENTS for x in value.split()):
                    found = max(found, READERS)
                elif tokens & BOILERPLATE or not inside and tokens & HEADERS:
                    found = max(found, MARK)
        return found


def smooth(values: list[float], radius: int = RADIUS) -> list[float]:
    """Gaussian smoothing with the kernel cut at the ends of the list."""
    kernel = [math.exp(-(k * k) / (2.0 * radius * radius)) for k in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - radius), min(len(values), i + radius + 1)
        w = kernel[lo - i + radius:hi - i + radius]
        out.append(sum(a * b for a, b in zip(values[lo:hi], w, strict=True)) / sum(w))
    return out


def content_lines(lines: list[list]) -> list[bool]:
    """Threshold clustering of the smoothed ratios; silent lines count as 0."""
    ratios = smooth([0.0 if line[4] else len(line[0]) / max(1, line[1]) for line in lines])
    mean = sum(ratios) / len(ratios)
    deviation = math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
    return [r >= LAMBDA * deviation and not line[4] for r, line in zip(ratios, lines, strict=True)]


def is_links(line: list) -> bool:
    return line[2] >= LINK_SHARE * len(line[0])


def silence(parser: Lines) -> None:
    """Silence the lines below the marked elements whose marks hold."""
    marks, inner = parser.marks, [-1] * len(parser.names)  # the innermost marked element of each
    for k, parent in enumerate(parser.parents):  # parents come before their children
        inner[k] = k if k in marks else inner[parent] if parent >= 0 else -1
    own = dict.fromkeys([-1, *marks], 0)
    for line, good in zip(parser.lines, content_lines(parser.lines), strict=True):
        if good and not is_links(line):
            own[inner[line[3]]] += len(line[0])
    whole, nested = dict(own), {m: [] for m in own}
    for m in sorted(marks, reverse=True):
        up = inner[parser.parents[m]]
        whole[up] += whole[m]
        nested[up].append(m)
    clean, dropped = own[-1], set()
    heap = [(marks[m], -whole[m], m) for m in nested[-1]]
    heapq.heapify(heap)
    while heap and clean < CLEAN_SHARE * whole[-1]:
        mark, weight, m = heapq.heappop(heap)
        if mark == READERS and clean:
            break
        if weight:
            dropped.add(m)
            clean += own[m]
            for x in nested[m]:
                heapq.heappush(heap, (marks[x], -whole[x], x))
    held = [False] * len(parser.names)
    for k, parent in enumerate(parser.parents):
        held[k] = k in marks and k not in dropped or parent >= 0 and held[parent]
    for line in parser.lines:
        line[4] = line[4] or held[line[3]]


def region(parser: Lines, content: list[bool]) -> set[int]:
    """Numbers of the elements whose lines make up the main text."""
    weight = [0] * len(parser.names)
    for line, good in zip(parser.lines, content, strict=True):
        if good and not is_links(line):
            element = line[3]
            while element >= 0:
                weight[element] += len(line[0])
                element = parser.parents[element]
    roots = [k for k, name in enumerate(parser.names) if name in ("article", "main") and weight[k]]
    if not roots:
        at, below = 0, [[] for _ in parser.names]
        for k, parent in enumerate(parser.parents[1:], 1):
            below[parent].append(k)
        while True:
            best = max(below[at], key=weight.__getitem__, default=None)
            if best is None or parser.names[best] == "p" or not weight[at] or weight[best] < REGION_SHARE * weight[at]:
                break
            at = best
        roots = [at]
    chosen = set(roots)
    for k, parent in enumerate(parser.parents):  # parents come before their children
        if parent in chosen:
            chosen.add(k)
    return chosen


def extract(html: str | None) -> str:
    """Main text of one page: its blocks in order, one a line."""
    if not html:
        return ""
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a marked section that the parser does not know
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.cut()
    if not parser.lines:
        return ""
    if parser.marks:
        silence(parser)
    content = content_lines(parser.lines)
    chosen = region(parser, content)
    # outside an article, list items that are nothing but links are a menu
    held = any(parser.names[k] in ("article", "main") for k in chosen)
    menu = lambda line: not held and parser.names[line[3]] in ("li", "ul", "ol", "td") and is_links(line)
    return "\n".join(line[0] for line in parser.lines if not line[4] and line[3] in chosen and not menu(line))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(value.as_py()) for value in batch.column(2)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return map_batches(pages.select(page_id, url, html), run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
