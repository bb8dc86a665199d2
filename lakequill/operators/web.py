"""HTML pages to Markdown, listings and document links, on the standard library's parser, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser
from posixpath import splitext
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import DataFrame

from lakequill.functions.text import CHROME_MARKERS

LEAST_ITEMS = 5
LEAST_CONTEXT_WORDS = 2
#: Extensions of documents that are linked from pages.
DOCUMENTS = (".pdf", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".odt")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head nav header footer aside form".split())
BLOCKS = {"p": "", "li": "- ", "blockquote": "> ", "h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "div": "", "section": "", "article": "", "main": "", "td": "", "th": "", "tr": "", "pre": "", "dt": "", "dd": "", "figcaption": ""}
#: Stands among the names around an element for one with the role main.
ROLE_MAIN = "role=main"
SCHEMA = "url string, kind string, text string, sha256 string, char_count long, language string, title string, links array<struct<label: string, url: string, context: string>>, documents array<struct<label: string, url: string>>, error string"


class Node:
    """An element: name, attributes, parent, the names of all elements around it, and its children and texts in order."""

    __slots__ = ("name", "attrs", "up", "above", "parts")

    def __init__(self, name: str, attrs: dict, up: Node | None):
        self.name, self.attrs, self.up, self.parts = name, attrs, up, []
        own = {up.name, ROLE_MAIN} if up is not None and up.attrs.get("role") == "main" else {up.name} if up is not None else set()
        self.above: frozenset[str] = frozenset(own) if up is None or not up.above else up.above if own <= up.above else up.above | own  # shared while no new name comes

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(p for p in reversed(node.parts) if isinstance(p, Node))

    def texts(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in ("script", "style", "template"):
                stack.extend(reversed(x.parts))

    def text(self) -> str:
        return " ".join(" ".join(self.texts()).split())

    def inside(self, names: frozenset[str] | tuple[str, ...]) -> bool:
        return not self.above.isdisjoint(names)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.open: Counter[str] = Counter()  # names of the elements that are open now

    def _leave(self) -> None:
        self.open[self.at.name] -= 1
        self.at = self.at.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.at.name in ("p", "li", "dt", "dd", "option") and (tag == self.at.name or self.at.name == "p" and tag in BLOCKS):
            self._leave()
        node = Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        while self.at.name != tag:
            self._leave()
        self._leave()

    def handle_data(self, data: str) -> None:
        self.at.parts.append(data)


def parsed(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def main_of(root: Node) -> Node | None:
    """The first main, role=main or article."""
    return next((n for n in root.walk() if n.name in ("main", "article") or n.attrs.get("role") == "main"), None)


def to_markdown(node: Node) -> str:
    """Headings, paragraphs, items, emphasis; without links' targets, menus, forms and scripts."""
    lines: list[str] = []
    held: list[str] = []

    def close(prefix: str) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            lines.append(prefix + text)

    open_ = [(iter(node.parts), "", None)]  # of each element its parts to come, its prefix and the one that its end closes with
    while open_:
        parts, prefix, closing = open_[-1]
        for part in parts:
            if isinstance(part, str):
                held.append(part)
            elif part.name in SKIPPED:
                continue
            elif part.name in BLOCKS:
                close(prefix)
                own = BLOCKS[part.name] or prefix
                open_.append((iter(part.parts), "" if part.name in ("div", "section", "article", "main") else own, own))
                break
            elif part.name == "br":
                held.append(" ")
            elif part.name in ("b", "strong", "i", "em") and (text := part.text()):
                held.append(f"**{text}**" if part.name in ("b", "strong") else f"*{text}*")
            else:
                open_.append((iter(part.parts), prefix, None))
                break
        else:
            open_.pop()
            if closing is not None:
                close(closing)
    close("")
    return clean("\n\n".join(lines))


def clean(markdown: str) -> str:
    """functions.text.markdown_clean for one text."""
    lines = [x.strip() for x in markdown.splitlines()]
    kept = "\n".join(x for x in lines if "cookie" not in x.lower())
    return re.sub(r"\n{3,}", "\n\n", kept).strip()


def is_chrome(markdown: str) -> bool:
    low = " ".join(markdown.lower().split())
    return any(m in low for m in CHROME_MARKERS)


def prose(root: Node) -> str:
    """The main part's Markdown, unless it is web chrome; then the whole body's; then whatever came first."""
    first = to_markdown(main_of(root) or root)
    if first and not is_chrome(first):
        return first
    whole = to_markdown(root)
    return whole if whole and not is_chrome(whole) else first


def listing_links(root: Node, url: str, items: bool = True) -> list[dict]:
    """The labelled links of repeated containers: the first kind of container that gives five or more."""
    main = main_of(root)
    order = list(main.walk()) if main else []
    nested: set[int] = set()  # elements that hold containers
    anchors: dict[int, list[tuple[Node, str]]] = {}  # of each element its labelled links, two at most
    for n in reversed(order):  # children first
        own = anchors.setdefault(id(n), [])
        if n.name == "a" and n.attrs.get("href") and (label := n.text()):
            own.insert(0, (n, label))
        if n is not main:
            above = anchors.setdefault(id(n.up), [])
            above[:0] = own[: 2 - len(above)]
            if n.name in ("article", "li", "section") or id(n) in nested:
                nested.add(id(n.up))
    for kind in ("article", "section", "div", *(("li",) if items else ())) if main else ():
        found: dict[tuple, dict] = {}
        for box in order:
            if box is main or box.name != kind or box.inside(("nav", "header", "footer", "aside")):
                continue
            if id(box) in nested or len(anchors[id(box)]) != 1:
                continue
            a, label = anchors[id(box)][0]
            if (label, urljoin(url, a.attrs["href"])) in found or label.isdigit() or label in ("...", "‹", "›", "<", ">"):
                continue
            context = box.text()
            if context.startswith(label):
                context = context[len(label) :].lstrip(" -:,.")
            if len(context.split()) >= LEAST_CONTEXT_WORDS:
                link = {"label": label, "url": urljoin(url, a.attrs["href"]), "context": context}
                found.setdefault((label, link["url"]), link)
        if len(found) >= LEAST_ITEMS:
            return list(found.values())
    return []


def document_links(root: Node, url: str) -> list[dict]:
    """Links to documents in main parts and articles; the first of each url."""
    found: dict[str, dict] = {}
    for n in root.walk():
        if n.name == "a" and n.attrs.get("href") and (n.inside(("main", "article", ROLE_MAIN)) or n.attrs.get("role") == "main"):
            target = urljoin(url, n.attrs["href"])
            if splitext(urlparse(target).path.lower())[1] in DOCUMENTS:
                found.setdefault(target, {"label": n.text(), "url": target})
    return list(found.values())


def is_child(page: str, link: str) -> bool:
    a, b = urlparse(page), urlparse(link)
    return a.netloc == b.netloc and b.path.startswith(a.path.rstrip("/") + "/")


def page_kind(root: Node, url: str, text: str) -> str:
    if not text.strip():
        return "listing" if listing_links(root, url) else "empty"
    children = [x for x in listing_links(root, url, items=False) if is_child(url, x["url"])]
    return "listing" if len(children) >= LEAST_ITEMS and any(x["label"] not in text for x in children) else "prose"


def listing_markdown(links: list[dict], title: str | None = None) -> str:
    head = [f"# {title}", ""] if title and links else []
    return clean("\n".join(head + [line for x in links for line in (f"- [{x['label']}]({x['url']})", x["context"])]))


def language_of(root: Node) -> str | None:
    lang = next((n.attrs.get("lang") for n in root.walk() if n.name == "html"), None)
    lang = lang or next((n.attrs.get("content") for n in root.walk() if n.name == "meta" and (n.attrs.get("http-equiv") or "").lower() == "content-language"), None)
    return re.split("[-_]", lang.strip())[0].lower() or None if lang else None


def is_contact_footer(text: str) -> bool:
    low = text.lower()
    return len(text) <= 400 and "@" in low and ("+" in low or "tel" in low)


def extract_page(url: str, html: str | None) -> tuple:
    """One row of SCHEMA. A contact footer instead of prose looks for a document; then listing, prose, document, empty."""
    try:
        root = parsed(html or "")
        text = prose(root)
        kind = page_kind(root, url, text)
        links = listing_links(root, url) if kind == "listing" else []
        documents = document_links(root, url)
        title = next((n.text() or None for n in root.walk() if n.name == "title"), None)
        if documents and is_contact_footer(text):
            kind, text = "document", ""
        elif kind == "listing":
            text = listing_markdown(links, title)
        elif kind == "empty" and documents:
            kind = "document"
        return url, kind, text, sha256(text.encode()).hexdigest() if text else None, len(text), language_of(root), title, links, documents, None
    except Exception as e:  # one page's failure is that page's row
        return url, "error", "", None, 0, None, None, [], [], f"{type(e).__name__}: {e}"[:500]


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (url, html) to one row each: kind prose, listing, document, empty or error, the Markdown, its hash, links."""
    names = [x.split()[0] for x in re.split(r", (?=\w+ (?:string|long|array))", SCHEMA)]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            yield pd.DataFrame([extract_page(u or "", h) for u, h in zip(pdf["url"], pdf["html"])], columns=names)

    return pages.select("url", "html").mapInPandas(run, SCHEMA)
