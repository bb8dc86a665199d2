"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page's events into lines: the text of one block element each, with the number
of tags that stand in and before it. Lines inside elements that are never article text (menus, footers, forms, ...) get
the ratio 0. The ratios are smoothed by a Gaussian, so that short blocks among long ones rise and lone boxes fall, and
split by a threshold into content and rest. The content lines vote, by their length, for the innermost element that
holds nearly all of them; of that region all lines stay but those of plain boxes in which no line is content.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from lakequill.llm.common import column, text_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data dfn del em font i img ins kbd label map mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose text is never part of an article.
NEVER = frozenset("head title script style noscript template nav footer aside form button select option textarea input dialog iframe object svg canvas math audio video menu datalist".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
REGION = frozenset(("article", "main"))
#: Parts of a text: never the region itself.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table caption thead tbody tfoot tr td th pre blockquote figure figcaption details summary address hgroup".split())
#: Elements that say nothing about what they hold: they need content lines to count.
BOXES = frozenset(("div", "section", "center"))
#: What a closing paragraph or item implies.
CLOSES = {
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",)),
}
#: Words in class or id that mark what isn't article text.
MARKS = frozenset(
    """ad ads adv advert advertisement advertising adsense adslot adunit banner sponsor sponsored promo promotion promoted
    sidebar sidenav menu nav navbar navigation navi breadcrumb breadcrumbs pagination pager toolbar masthead topbar
    footer header cookie cookies consent gdpr notice notification alert popup modal overlay lightbox newsletter subscribe
    subscription signup login paywall share sharing social related recommended recommendations widget comment comments
    commentlist respond reply replies disqus discussion responses skip hidden""".split()
)
NOT_AFTER = frozenset("no has with without non".split())
#: The header of one of these belongs to the text; related is a mark by itself and before one of those.
HEADED = frozenset("article post entry story section".split())
RELATED = frozenset("posts post articles article links link stories items content news pages reading topics videos box list sidebar widget products".split())
#: A comment, declaration or tag that the page's end cuts off: browsers show nothing of it.
UNCLOSED = re.compile(r"<(?:!|\?|/?[A-Za-z])")
DENSE_LINKS = 0.5
SIGMA = 1.0
#: The region holds this share of the content at least; a run of content lines below STRAY of the largest has no vote.
HELD = 0.9
STRAY = 0.1


class Line(NamedTuple):
    text: str
    tags: int
    linked: int
    never: bool
    heading: bool
    inside: tuple[int, ...]


def _marked(value: str) -> bool:
    words = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", value)
    for name in words.split():
        parts = re.split(r"[^a-z0-9]+", name.lower())
        for i, p in enumerate(parts):
            before, after = parts[i - 1] if i else "", parts[i + 1] if i + 1 < len(parts) else ""
            if p in MARKS and before not in NOT_AFTER and not (p == "header" and before in HEADED) and not (p == "related" and after and after not in RELATED):
                return True
    return False


class Events(HTMLParser):
    """Parser events to lines. An element is (name, number, never, links)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []
        self.names: dict[int, str] = {}
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.regions = 0
        self.never = 0
        self.heading = False

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                inside = tuple(n for name, n, _ in self.open if name not in INLINE)
                self.lines.append(Line(text, self.tags, self.linked, self.never > 0, self.heading, inside))
                self.tags = 0
            self.parts.clear()
            self.linked = 0

    def pop(self) -> None:
        name, _, never = self.open.pop()
        self.never -= never
        self.links -= name == "a"
        self.regions -= name in REGION

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE and tag != "br" and tag in VOID or tag == "br":
            if tag == "br":
                self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            while self.open and self.open[-1][0] in INLINE and any(n == "p" for n, _, _ in self.open):
                self.pop()
            if self.open and self.open[-1][0] == "p":
                self.pop()
            if also := CLOSES.get(tag):
                for i in reversed(range(len(self.open))):
                    if self.open[i][0] in also:
                        while len(self.open) > i:
                            self.pop()
                    elif self.open[i][0] not in INLINE and self.open[i][0] != "p":
                        break
            if tag == "body":
                while any(n == "head" for n, _, _ in self.open):
                    self.pop()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
        if tag in VOID:
            return
        got = dict(attrs) if attrs else {}
        never = tag in NEVER or (tag == "header" and not self.regions)
        if got and not never:
            role = (got.get("role") or "").lower()
            style = (got.get("style") or "").replace(" ", "").lower()
            never = role in NEVER_ROLES or "hidden" in got or (got.get("aria-hidden") or "").lower() == "true" or "display:none" in style
            if not never and tag not in ("html", "body", "main", "article", "a", "p") and not (tag in INLINE and self.regions):
                never = _marked(f"{got.get('class') or ''} {got.get('id') or ''}")
        number = len(self.names)
        self.names[number] = "main" if got.get("role") == "main" else tag
        self.open.append((tag, number, never))
        self.never += never
        self.links += tag == "a"
        self.regions += tag in REGION

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
            self.heading = False
        for i in reversed(range(len(self.open))):
            name = self.open[i][0]
            if name == tag:
                while len(self.open) > i:
                    self.pop()
                return
            if tag in INLINE and name not in INLINE or tag == "p" and name not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        self.parts.append(data)
        if self.links:
            self.linked += len(data.strip())


def lines_of(html: str) -> tuple[list[Line], dict[int, str]]:
    events = Events()
    events.feed(html)  # at once: what is still open at the end of a piece would be scanned anew with each further one
    if UNCLOSED.match(events.rawdata):
        events.rawdata = ""
    events.close()
    events.flush()
    return events.lines, events.names


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; at the ends the weights that are there count."""
    reach = max(1, math.ceil(2 * sigma))
    weight = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        low, high = max(0, i - reach), min(len(values), i + reach + 1)
        w = weight[low - i + reach : high - i + reach]
        out.append(sum(a * b for a, b in zip(w, values[low:high], strict=True)) / sum(w))
    return out


def runs_of(picked: list[int], lines: list[Line]) -> list[list[int]]:
    """Picked lines in runs; what is between two lines of a run is one line at most, or never text."""
    runs: list[list[int]] = []
    for i in picked:
        if runs and sum(not lines[k].never for k in range(runs[-1][-1] + 1, i)) <= 1:
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def content(lines: list[Line], names: dict[int, str]) -> list[Line]:
    """The lines of the content region."""
    usable = [i for i, x in enumerate(lines) if not x.never]
    if not usable:
        return []
    ratio = [0.0 if x.never else (len(x.text) - x.linked) / max(1, x.tags) for x in lines]
    smooth = smoothed(ratio)
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    picked = [i for i in usable if ratio[i] > 0 and smooth[i] >= threshold] or [i for i in usable if ratio[i] > 0] or usable
    size = lambda run: sum(len(lines[i].text) for i in run)
    runs = runs_of(picked, lines)
    largest = max(map(size, runs))
    mass: dict[int, int] = {}
    total = 0
    for run in runs:
        if size(run) >= STRAY * largest:
            total += size(run)
            for i in run:
                for n in lines[i].inside:
                    mass[n] = mass.get(n, 0) + len(lines[i].text)
    region = max((n for n, m in mass.items() if m >= HELD * total and names[n] not in PARTS), default=None)
    inside = [i for i in picked if region is None or region in lines[i].inside]
    first, last, boxes = inside[0], inside[-1], {n for i in inside for n in lines[i].inside}
    while first and lines[first - 1].heading and not lines[first - 1].never and len(lines[first - 1].inside) <= len(lines[first].inside):
        first -= 1  # the headings over the text belong to it wherever they stand

    def kept(i: int, x: Line) -> bool:
        if x.never:
            return False
        if region is not None and region not in x.inside:
            return x.heading and first <= i <= last
        if not first <= i <= last and x.linked > DENSE_LINKS * len(x.text):
            return False
        return not any(names[n] in BOXES and n not in boxes for n in (x.inside if region is None else x.inside[x.inside.index(region) :]))

    return [x for i, x in enumerate(lines) if kept(i, x)]


def main_text(html: str | None) -> str:
    """The page's blocks of article text, one a line; empty if there is none."""
    return "\n".join(x.text for x in content(*lines_of(html))) if html else ""


def _texts() -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            texts = [main_text(h) for h in got.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, text, n_chars (code points).

    Null or empty html, or a page without article text, gives an empty text. Broken markup is read as far as browsers
    do: paragraphs and items close each other, an end tag closes what it holds, and of a comment or tag that the page's
    end cuts off nothing is shown. White space inside a block becomes one
    blank; pages of any length are read whole; an empty table gives an empty result.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    narrow = pages.select(column(pages, id_col).alias("id"), column(pages, url_col).cast("string").alias("url"), text_of(column(pages, html_col)).alias("html"))
    return narrow.mapInArrow(_texts(), f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
