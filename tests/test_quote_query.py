from __future__ import annotations

import json
import re

import pyarrow.parquet as pq

from lakequill.plans import build_queries  # noqa: F401  importing it registers the query
from lakequill.plans.registry import QUERIES


def folded(s):
    return re.sub(r"\s+", " ", re.sub(r"\*+|\[\d+\]", "", s))


def test_quotes_from_all_parts_are_found_where_brute_force_finds_them(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = QUERIES["quote_spans"](spark, sf).collect()
    assert len(got) == len(texts)
    latest = 0.0
    for r in got:
        text = texts[r.doc_id]
        n = len(text)
        quotes = [folded(q).strip() for q in (text[:40], text[49:79], text[n // 2 : n // 2 + 40], text[max(0, n - 40) :])]
        want = [q for q in quotes if q and q in folded(text)]
        spans = json.loads(r.spans)
        assert len(spans) == len(want) and r.ok == (len(want) == len(quotes))
        for q, (start, end) in zip(want, spans):
            before = folded(text[:end])
            assert folded(text[start:end]).strip() == q and before.find(q) == len(before) - len(q)  # the first occurrence ends there
            latest = max(latest, start / n if n > 2_000 else 0.0)
    assert latest > 0.9
