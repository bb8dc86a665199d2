"""Fetching pages and documents. The network is behind Fetcher, so jobs run offline with a stub."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Protocol
from uuid import NAMESPACE_URL, uuid5

import pandas as pd
from pyspark.sql import DataFrame

from lakequill.operators.web import extract_page

MOST_DOCUMENT_BYTES = 20_000_000
CERTIFICATE = ("certificate", "ssl")
SCHEMA = "source string, url string, final_url string, status int, content_type string, html string, error string, fetched_at timestamp"


@dataclass(frozen=True)
class Response:
    url: str
    status: int
    content_type: str | None
    body: str


class Fetcher(Protocol):
    def __call__(self, url: str, timeout: float) -> Response: ...


def urllib_fetcher(url: str, timeout: float, agent: str = "lakequill") -> Response:
    """The standard library's client."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, headers={"User-Agent": agent})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            charset = r.headers.get_content_charset() or "utf-8"
            body = r.read(MOST_DOCUMENT_BYTES + 1)
            if len(body) > MOST_DOCUMENT_BYTES:
                raise ValueError(f"more than {MOST_DOCUMENT_BYTES} bytes")
            return Response(r.url, r.status, r.headers.get("content-type"), body.decode(charset, "replace"))
    except urllib.error.HTTPError as e:
        return Response(url, e.code, e.headers.get("content-type"), e.read(1 << 20).decode("utf-8", "replace"))


def fetch(url: str, get: Fetcher, other: Fetcher | None = None, timeout: float = 20.0, wait: Callable[[float], None] = time.sleep, pause: float = 2.0) -> Response:
    """One retry on 429 and 5xx, plain http where only the certificate fails, the other client where a robot policy refuses this one."""

    def tries(u: str) -> Response:
        r = get(u, timeout)
        if r.status == 429 or r.status >= 500:
            wait(pause)
            r = get(u, timeout)
        return r

    try:
        found = tries(url)
    except Exception as e:
        if not (url.startswith("https://") and any(c in f"{type(e).__name__} {e}".lower() for c in CERTIFICATE)):
            raise
        found = tries("http://" + url.removeprefix("https://"))
    if other and found.status == 403 and "robot policy" in found.body.lower():
        return other(url, timeout)
    return found


def fetch_all(urls: DataFrame, get: Fetcher = urllib_fetcher, other: Fetcher | None = None, timeout: float = 20.0, delay: float = 1.0) -> DataFrame:
    """urls (source, url) to a row each; a failure is that row's error. Give each host one partition and `delay` holds between its requests."""
    from pyspark.sql import functions as F

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for pdf in source:
            rows = []
            for s, url in zip(pdf["source"], pdf["url"]):
                host = url.split("/")[2] if "://" in url else url
                ready = last.get(host, 0.0) + delay - time.monotonic()
                if delay > 0 and ready > 0 and host in last:
                    time.sleep(ready)
                last[host] = time.monotonic()
                at = datetime.now(UTC).replace(tzinfo=None)
                try:
                    r = fetch(url, get, other, timeout)
                    rows.append((s, url, r.url, r.status, r.content_type, r.body, None, at))
                except Exception as e:
                    rows.append((s, url, None, None, None, None, f"{type(e).__name__}: {e}"[:500], at))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"status": "Int32"})

    hosts = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.col("url"))
    return urls.select("source", "url").repartition(hosts).mapInPandas(run, SCHEMA)


def with_text(fetched: DataFrame, render: Callable[[str], str] | None = None, convert: Callable[[str], tuple[str, str | None]] | None = None) -> DataFrame:
    """Fetch results to rows of the fetched log: the page's Markdown instead of its HTML. What isn't a usable page has its reason as error and no text."""
    from pyspark.sql import functions as F

    from lakequill.functions.text import response_error
    from lakequill.schemas import FETCHED

    refused = response_error(F.col("status"), F.col("content_type"), F.col("html"))
    rows = fetched.withColumn("error", F.coalesce("error", refused))
    names = [c.split()[0] for c in FETCHED.split(", ")]

    def run(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in source:
            out = []
            for r in pdf.itertuples(index=False):
                page = (None, None, "", None, 0, None, None, None, None, None) if isinstance(r.error, str) else extract_with(r.final_url or r.url, r.html or "", render, convert)
                values = r._asdict() | {"id": str(uuid5(NAMESPACE_URL, r.url)), "text": page[2], "sha256": page[3], "char_count": page[4], "language": page[5], "title": page[6], "error": r.error if isinstance(r.error, str) else page[9]}
                out.append([values[n] for n in names])
            yield pd.DataFrame(out, columns=names).astype({"status": "Int32"})

    return rows.mapInPandas(run, FETCHED)


def first_document(links: list[dict], convert: Callable[[str], tuple[str, str | None]]) -> tuple[str, str | None, str | None]:
    """(markdown, url, error) of the first link that gives text; an error ends the search. convert returns (markdown, error)."""
    for link in links:
        text, error = convert(link["url"])
        if error:
            return "", link["url"], error
        if text.strip():
            return (f"# {link['label']}\n\n{text}" if link["label"] else text), link["url"], None
    return "", None, None


def extract_with(url: str, html: str, render: Callable[[str], str] | None = None, convert: Callable[[str], tuple[str, str | None]] | None = None) -> tuple:
    """web.extract_page, with a document's text where the page is one, and the rendered page where it shows nothing."""
    row = list(extract_page(url, html))
    if row[1] == "document" and convert:
        text, _, error = first_document(row[8], convert)
        row[2], row[4], row[9] = text, len(text), error
    if row[1] == "empty" and render:
        row = list(extract_page(url, render(url)))
    return tuple(row)
