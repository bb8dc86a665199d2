"""URL verdicts by a sort-merge range join of urls and rules.

A host's labels are reversed ("a.example.com" becomes "com.example.a.") so a rule's host and all its subdomains are one
interval of keys. Each batch sorts its distinct hosts, and one sweep over them and the sorted rule hosts keeps a stack
of the rule hosts whose intervals are open. Within a rule host the path prefixes are nested intervals too: a binary
search finds the last rule that sorts at or before the path, and its chain of enclosing rules ends at the longest fit.
A verdict depends on the url and the rules alone, so the urls stay in place: no shuffle, and no host can be hot.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import UPPER, column

#: A block of rules travels with the tasks; its bytes stay under this. More rules make more blocks, one pass each.
BLOCK_BYTES = 16 << 20


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def reversed_host(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


class PathRules:
    """The path prefixes of one rule host in order, each with the nearest prefix that encloses it."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(rules, key=lambda r: r.path)
        self.paths = [r.path for r in self.rules]
        self.outer: list[int] = []
        stack: list[int] = []
        for i, path in enumerate(self.paths):
            while stack and not path.startswith(self.paths[stack[-1]]):
                stack.pop()
            self.outer.append(stack[-1] if stack else -1)
            stack.append(i)

    def longest(self, path: str) -> Rule | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.outer[i]
        return self.rules[i] if i >= 0 else None


def sweep(hosts: Sequence[str], rules: Sequence[tuple[str, PathRules]]) -> Iterator[tuple[str, list[PathRules]]]:
    """hosts: reversed, sorted, distinct. rules: by reversed host, sorted. Each host with its open rule hosts, outermost first."""
    stack: list[tuple[str, PathRules]] = []
    k = 0
    for host in hosts:
        while k < len(rules) and rules[k][0] <= host:
            while stack and not rules[k][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[k])
            k += 1
        while stack and not host.startswith(stack[-1][0]):
            stack.pop()
        yield host, [r for _, r in stack]


def longest_rules(pairs: Sequence[tuple[str, str]], ordered: Sequence[tuple[str, PathRules]]) -> list[Rule | None]:
    """The longest rule (host and path together; ties go to the longer host) of each (host, path)."""
    by_host: dict[str, list[int]] = {}
    for i, (host, _) in enumerate(pairs):
        by_host.setdefault(reversed_host(host), []).append(i)
    out: list[Rule | None] = [None] * len(pairs)
    for key, active in sweep(sorted(by_host), ordered):
        for i in by_host[key] if active else ():
            for rules in active:
                found = rules.longest(pairs[i][1])
                if found and (out[i] is None or len(found.name) >= len(out[i].name)):
                    out[i] = found
    return out


def prepared(rules: Sequence[Rule]) -> list[tuple[str, PathRules]]:
    by_host: dict[str, list[Rule]] = {}
    for r in dict.fromkeys(rules):
        by_host.setdefault(reversed_host(r.host), []).append(r)
    return sorted((key, PathRules(found)) for key, found in by_host.items())


def blocks(rules: Sequence[Rule], most: int = BLOCK_BYTES) -> Iterator[list[Rule]]:
    held: list[Rule] = []
    size = 0
    for r in rules:
        cost = len(r.host) + len(r.path) + 200
        if held and size + cost > most:
            yield held
            held, size = [], 0
        held.append(r)
        size += cost
    yield held


def _judge(rules: Sequence[Rule]) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered = prepared(rules)
        for got in source:
            names, verdicts = got.column(3).to_pylist(), got.column(4).to_pylist()
            hosts = got.column(1).to_pylist()
            for i, found in enumerate(longest_rules(list(zip(hosts, got.column(2).to_pylist(), strict=True)), ordered)):
                if found and (names[i] is None or (len(found.name), len(found.host)) > (len(names[i]), len(names[i].split("/")[0]))):
                    names[i], verdicts[i] = found.name, found.verdict
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), got.column(2), pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["id", "host", "path", "rule", "verdict"])

    return run


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def url_filter(urls: DataFrame, rules: Sequence[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of urls: id, host, path, rule (null if none fits), verdict.

    rules: Rule rows, or a DataFrame (host, path, verdict) that is read block by block; no block exceeds BLOCK_BYTES and
    each makes one more pass, so any number of rules works. A rule fits its host and all subdomains if the path starts
    with its path; the longest wins; repeated rules count once. Null urls and urls without :// have empty host and path,
    which no rule with a path fits, and get the default verdict. An empty table or no rules: no rows, or all default.
    """
    host, path = host_and_path(column(urls, url_col).cast("string"))
    out = urls.select(column(urls, id_col).alias("id"), host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    kind = out.schema["id"].dataType.simpleString()
    if isinstance(rules, DataFrame):
        rules = (Rule(r[0] or "", r[1] or "", r[2] or default) for r in rules.select("host", "path", "verdict").toLocalIterator())
    for block in blocks(rules):
        if block:
            out = out.mapInArrow(_judge(block), f"id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("id", id_col)
