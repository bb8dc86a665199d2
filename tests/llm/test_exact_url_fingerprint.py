from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lakequill.llm import exact_dedup as X
from lakequill.llm import fingerprint, url_filter
from lakequill.llm.url_filter import Rule

SCHEMA = "doc_id long, text string, n long, kept boolean"  # the last two clash with what operators make


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, True) for i, t in rows], SCHEMA)


CASES = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 200_000), (7, "x" * 200_000), (None, "abc"), (None, None), (9, "Abc ")]


def test_exact_dedup_edges(spark):
    got = [r.asDict() for r in X.exact_dedup(docs(spark, CASES)).collect()]
    assert len(got) == len(CASES)
    by: dict = {}
    for i, t in CASES:
        norm = "".join(c.lower() if c.isascii() else c for c in t or "")
        by.setdefault(norm, []).append(i)
    for norm, ids in by.items():
        sha = hashlib.sha256(norm.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == sha]
        assert sorted(r["doc_id"] or -1 for r in mine) == sorted(i or -1 for i in ids)
        assert {r["keep_id"] for r in mine} == {max((i for i in ids if i), default=None)}
        assert {r["group_size"] for r in mine} == {len(ids)} and sum(r["kept"] for r in mine) == 1


def test_exact_dedup_empty_and_kept_rows(spark):
    assert X.exact_dedup(docs(spark, [])).count() == 0
    kept = X.kept_rows(docs(spark, CASES))
    assert kept.columns == ["doc_id", "text", "n", "kept"]
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [2, 4, 5, 6, 7, 9]


@pytest.mark.parametrize("budget", [1, 50, 10_000])
def test_grace_spills_and_equals_a_dict(budget, tmp_path):
    rng = random.Random(3)
    rows = [(rng.getrandbits(3) << 61 | rng.getrandbits(2), bytes([rng.randrange(5)]) * rng.randrange(4), 1) for _ in range(500)]
    want: dict = {}
    for h, c, _ in rows:
        want[h, c] = want.get((h, c), 0) + 1
    got = list(X.grace(iter(rows), lambda a, b: a + b, budget, folder=str(tmp_path)))
    assert {(h, c): n for h, c, n in got} == want and len(got) == len(want)
    assert not list(tmp_path.iterdir())


def test_small_budget_gives_the_same(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(X.exact_dedup(d, budget_bytes=2_000)) == key(X.exact_dedup(d))


RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.net", "/en/x", "block"), Rule("b.example.net", "/e", "block"), Rule("com", "", "block"), Rule("example.com", "/a", "allow")]
URLS = ["http://a.net/x", "http://a.net", "HTTP://A.EXAMPLE.NET/en/1", "https://b.example.net/en/", "http://example.net/en/xy", "http://notexample.net/en/", "http://q.example.com/ab?x#y", "ftp://com", "no host", "", None, "a://b://c.net/", "http://x.com?q=/a", "http://x.net/\nen", "http://.net/", "http://example.com/A"]


def brute(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_urls_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(url_filter, "BLOCK_BYTES", block)
    monkeypatch.setattr(url_filter.blocks, "__defaults__", (block,))
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, RULES).collect()}
    assert got == {i: brute(u) for i, u in enumerate(URLS)}
    assert url_filter.url_filter(df.limit(0), RULES).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, []).collect()} == {"allow"}
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df, table).collect()} == got


def edited(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_next_row_in_any_ranges(spark, ranges):
    ids = [5, 5, 900_000_000, 900_000_001, 900_000_002, None, None, -7, 0, 1, 2, 3]
    df = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id long, text string")
    got = fingerprint.with_next(df, [F.col("text")], ["text"], "id", ranges).collect()
    order = sorted(((i, f"t{k}") for k, i in enumerate(ids)), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert {r.text: r.next_text for r in got} == {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)} and len(got) == len(ids)


def test_fingerprints_equal_brute_force(spark):
    texts = ["Hello  World", "hello world ", "Straße", "STRASSE", "ﬁne é", "fine é", "", None, "😀😀 abc", "a", "long " * 30_000, "Hello  World"]
    df = spark.createDataFrame([(i * 7 % 50 if i else 99, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string")
    order = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited(text, following).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and got[i].near_next in (0.0, 1.0)
    fp = {(r.text or ""): got[r.doc_id].fingerprint for r in df.collect()}
    assert fp["Hello  World"] == fp["hello world "] and fp["Straße"] == fp["STRASSE"] and fp["ﬁne é"] == fp["fine é"]
    assert len(set(fp.values())) == len(fp) - 3


def test_fingerprints_compare_bytes_when_digests_collide(spark):
    weak = lambda c: F.struct(F.lit(1).cast("long").alias("hi"), F.length(c).cast("long").alias("lo"))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "AA"), (None, "cc"), (None, None)], "doc_id long, text string")
    got = fingerprint.fingerprints(df, digest=weak).collect()
    by = {r.doc_id: r.fingerprint for r in got if r.doc_id}
    assert by[1] == by[3] != by[2] and len({r.fingerprint for r in got}) == 4
    assert [r.near_next for r in got if r.doc_id == 3] == [0.0]  # followed by bb, whose digest is the same
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    one = fingerprint.fingerprints(df.where("doc_id = 1")).first()
    assert one.near_next == 1.0  # a lone document follows itself


def test_exact_dedup_of_text_ids(spark):
    df = spark.createDataFrame([("b", "Same", 1), ("a", "same", 2), (None, "SAME", 3), ("a", "other", 4)], "key string, text string, __id int")
    got = {(r.key, r.text_sha256[:4]): (r.keep_id, r.group_size, r.kept) for r in X.exact_dedup(df, "key").collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, [("b", 3, True), ("b", 3, False), ("b", 3, False), ("a", 1, True)]))
    assert sorted((r.key, r.text) for r in X.kept_rows(df, "key").collect()) == [("a", "other"), ("b", "Same")]
