"""Main text of HTML pages by line-block distribution.

Markup is stripped to lines, one per block element. Lines of navigation, forms, adverts and
the like have length zero; they leave gaps. The lengths are summed over a sliding window of
lines: the text begins where the sums surge and ends where they dive to zero, and what lies
between is kept whole. Where a page marks its article, the borders of the article end a block,
a gap inside does not, and the marked blocks are kept if they hold as many characters as the
blocks that surge outside them. If they hold fewer, the marks count for nothing.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import batches

WINDOW = 3  # lines of a window, and of a gap
SURGE = 86  # characters a window must hold for text to begin
MOST_LINKED = 0.5  # a line with more of its text in links is a menu

# HTML element names and the words sites name their parts by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
SKIPPED = frozenset(
    "head script style noscript template iframe nav footer aside form button select textarea option svg canvas "
    "object audio video map dialog menu title xmp noembed noframes fieldset label".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "caption"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select", "datalist"}),
}
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense adslot advertorial banner banners breadcrumb "
    "breadcrumbs comment comments commentlist commentarea consent cookie cookies cookiebar copyright disclaimer disqus "
    "footer footers gdpr masthead menu menus modal nav navbar navigation navi newsletter notice notices notification "
    "notifications pager pagination paywall popup popups promo promoted promotion recommendations recommended related "
    "replies reply respond share sharing sidebar sidebars sidenav signup skyscraper social sponsor sponsored sponsors "
    "subscribe subscription tagcloud toolbar topbar trending widget widgets".split()
)
HEADER_NAMES = frozenset("header headers pageheader siteheader".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split()
)
ARTICLE = frozenset({"article", "main"})

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a name, and attributes: quoted values may hold >, and an unquoted one may hold quotes
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\s>\"'=/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*))?|[\s/\"'=])*)(?:>|\Z)",
    re.DOTALL,
)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


class Line(NamedTuple):
    text: str
    linked: int
    article: bool
    gap: bool  # something was left out before this line


class _Element(NamedTuple):
    name: str
    skip: bool
    article: bool
    link: bool


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is a part that no article has."""
    if name in SKIPPED or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    for key, value in _NAMED.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id"):
            if name == "article":  # its classes also name topics, as category-notices: the first word of each counts
                words = {w.lower() for c in value.split() for w in _PARTS.findall(c)[:1]}
            else:
                words = {w.lower() for w in _PARTS.findall(value)}
            if words & NAMES or name != "article" and not in_article and words & HEADER_NAMES:
                return True
        elif key == "role" and value.lower() in ROLES:
            return True
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
        elif key == "style" and _HIDDEN.search(value):
            return True
    return False


class _Stripper:
    """Turns markup into lines, following the open elements."""

    def __init__(self) -> None:
        self.open: list[_Element] = []
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.linked = 0
        self.gap = False
        self.skipping = 0
        self.articles = 0
        self.links = 0

    def text(self, raw: str) -> None:
        if self.skipping:
            self.gap = self.gap or bool(raw.strip())
            return
        found = html.unescape(raw) if "&" in raw else raw
        self.words.append(found)
        if self.links:
            self.linked += len("".join(found.split()))

    def end_line(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append(Line(text, self.linked, self.articles > 0, self.gap))
            self.gap = False
        self.words, self.linked = [], 0

    def push(self, element: _Element) -> None:
        self.open.append(element)
        self.skipping += element.skip
        self.articles += element.article
        self.links += element.link

    def pop(self) -> None:
        element = self.open.pop()
        if element.name in BLOCKS or element.skip:
            self.end_line()
        self.skipping -= element.skip
        self.articles -= element.article
        self.links -= element.link
        if element.skip:
            self.gap = True

    def close_to(self, names: frozenset[str] | set[str], within: frozenset[str] | set[str]) -> None:
        """Close the nearest open element of ``names``, unless one of ``within`` is nearer."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at].name in names:
                while len(self.open) > at:
                    self.pop()
                return
            if self.open[at].name in within:
                return

    def start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self.close_to({"p"}, ENDS_P - {"p"} | {"td", "th", "body", "button"})
        if name in SIBLINGS:
            self.close_to(*SIBLINGS[name])
        if name in BLOCKS:
            self.end_line()
        if name in VOID:
            return
        skip = _left_out(name, attributes, self.articles > 0)
        if skip:
            self.end_line()
        self.push(_Element(name, skip, name in ARTICLE and not self.skipping, name == "a"))
        if attributes.endswith("/") and name in ("svg", "path", "use", "circle", "rect", "g"):
            self.pop()

    def end(self, name: str) -> None:
        if name in VOID:
            if name == "br":
                self.end_line()
            return
        if any(e.name == name for e in self.open):
            while self.open:
                last = self.open[-1].name
                self.pop()
                if last == name:
                    return
        elif name in BLOCKS:
            self.end_line()


def strip_markup(page: str) -> list[Line]:
    """The lines of a page without markup, scripts, forms and parts named as furniture.

    Character references are decoded, white space within a line is one space. Elements that
    are not closed end with the element around them.
    """
    stripper, at = _Stripper(), 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        if found is None:
            stripper.text(page[at:])
            break
        if found.start() > at:
            stripper.text(page[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if found[1]:
            stripper.end(name)
            continue
        stripper.start(name, found[3] or "")
        if name in RAW and not (found[3] or "").endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.IGNORECASE).search(page, at)
            stripper.gap = stripper.gap or name not in ("script", "style", "title")
            at = close.start() if close else len(page)
    stripper.end_line()
    while stripper.open:
        stripper.pop()
    return stripper.lines


class _Block(NamedTuple):
    lines: list[int]
    peak: int  # characters of its fullest window
    article: bool


def _blocks(lines: list[Line], marked: bool) -> list[_Block]:
    """The runs of lines between dive points; with ``marked`` an article's border is one."""
    sizes: list[int] = []
    place: list[int] = []
    for number, line in enumerate(lines):
        article = marked and line.article
        border = marked and number > 0 and line.article != lines[number - 1].article
        if border or line.gap and not article:
            sizes += [0] * WINDOW
            place += [-1] * WINDOW
        text = article or line.linked <= MOST_LINKED * len(line.text.replace(" ", ""))
        sizes.append(len(line.text) if text else 0)
        place.append(number)
    if not sizes:
        return []
    sums = np.convolve(sizes, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]  # of a line and those after it
    found: list[_Block] = []
    at = 0
    while at < len(sizes):
        if sums[at] == 0:
            at += 1
            continue
        dive = at
        while dive < len(sizes) and sums[dive] > 0:
            dive += 1
        inside = [place[i] for i in range(at, dive) if sizes[i]]
        found.append(_Block(inside, int(sums[at:dive].max()), marked and lines[inside[0]].article))
        at = dive
    return found


def keep_blocks(lines: list[Line]) -> list[str]:
    """The lines between surge and dive points of the line-block distribution."""
    size = lambda blocks: sum(len(lines[i].text) for block in blocks for i in block.lines)
    kept: list[_Block] = []
    if any(line.article for line in lines):
        blocks = _blocks(lines, marked=True)
        kept = [block for block in blocks if block.article]
        if size(kept) < size([block for block in blocks if not block.article and block.peak >= SURGE]):
            kept = []
    if not kept:
        blocks = _blocks(lines, marked=False)
        surge = min(SURGE, max((block.peak for block in blocks), default=0))
        kept = [block for block in blocks if block.peak >= surge]
    return [lines[i].text for block in kept for i in block.lines]


def main_text(page: str | None) -> str:
    """The kept lines of a page joined by line breaks; empty for null and for a page without text."""
    return "\n".join(keep_blocks(strip_markup(page))) if page else ""


def extract_text(rows: DataFrame, page: str) -> DataFrame:
    """``rows`` without ``page`` but with ``text`` and ``n_chars``, its code points.

    One narrow pass; every row gives one row. A null page has an empty text. Columns of the
    input named ``text`` or ``n_chars`` are replaced; all others are carried along.
    """
    carried = [c for c in rows.columns if c not in (page, "text", "n_chars")]
    kinds = dict(rows.dtypes)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, 256):
            texts = [main_text(p) for p in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(texts, pa.string()), sizes], names=[*carried, "text", "n_chars"]
            )

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "text string", "n_chars bigint"])
    return rows.select(*map(F.col, carried), F.col(page)).mapInArrow(run, schema)
