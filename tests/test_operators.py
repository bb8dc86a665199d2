from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakequill.operators import chunking, dense, evaluation, geo, qa, ranking, sparse, store, web
from lakequill.plans import catalog


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def ranked(frame, key="query_id"):
    return [r.chunk_id for r in frame.orderBy(key, "rank").collect()]


def test_sparse_leaves_out_what_shares_no_word(spark):
    docs = df(spark, "id string, text string", ("Q1", "Canonical castle chunk."), ("Q2", "Canonical forest chunk."), ("Q3", None))
    ask = lambda t: df(spark, "query_id long, text string", (1, t))
    assert ranked(sparse.bm25(ask("castle history"), docs)) == ["Q1"]
    assert sparse.bm25(ask("page"), docs).count() == 0
    assert sparse.bm25(ask("castle"), docs.limit(0)).count() == 0
    assert sparse.own_rank(df(spark, "query_id long, text string, own_id string", (1, "forest", "Q2"), (2, "nothing", "Q1")), docs, 5).orderBy("query_id").collect() == [(1, 1), (2, 6)]


def test_dense_and_groups(spark):
    chunks = df(spark, "chunk_id string, vec array<float>, page string", ("Q1", [1.0, 0.0], "a"), ("Q2", [0.0, 1.0], "b"), ("Q3", None, "c"), ("Q4", [1.0, 0.0], "b"))
    asked = df(spark, "query_id long, vec array<float>", (1, [1.0, 0.0]), (2, [0.0, 1.0]))
    got = dense.dense_top_k(asked, chunks.select("chunk_id", "vec"), 2)
    assert [(r.query_id, r.chunk_id) for r in got.orderBy("query_id", "rank").collect()] == [(1, "Q1"), (1, "Q4"), (2, "Q2"), (2, "Q1")]
    near = {r.chunk_id: r.other_id for r in dense.nearest_other(chunks.where("vec is not null"), "page").collect()}
    assert near == {"Q1": "Q4", "Q2": "Q1", "Q4": "Q1"}
    assert dense.dense_top_k(asked.limit(0), chunks, 2).count() == 0
    assert [r.chunk_id for r in dense.not_ready(chunks.select("chunk_id"), chunks).collect()] == ["Q3"]
    rank = dense.own_rank_margin(df(spark, "query_id long, vec array<float>, own_id string", (1, [0.8, 0.6], "Q2")), chunks.select("chunk_id", "vec")).first()
    assert (rank.dense_rank, rank.margin) == (3, -0.2)


def test_fusion(spark):
    schema = "query_id long, rank int, chunk_id string, score double"
    vector = df(spark, schema, (1, 1, "a", 0.9), (1, 2, "b", 0.8))
    words = df(spark, schema, (1, 1, "b", 100.0), (1, 2, "a", 10.0))
    got = ranking.fuse([(vector, 0.7), (words, 0.3)], 10).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.score, 9)) for r in got] == [("a", 0.7), ("b", 0.3)]
    flat = ranking.fuse([(df(spark, schema, (1, 1, "z", 5.0), (1, 2, "y", 5.0)), 1.0)], 10).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in flat] == [("z", 1.0), ("y", 1.0)]


def test_rerank_keeps_order_of_equals(spark):
    chunks = df(spark, "id string, text string", ("c1", "text 1"), ("c0", "text 0"))
    base = df(spark, "query_id long, rank int, chunk_id string, score double", (1, 1, "c1", 2.0), (1, 2, "c0", 1.0))
    queries = df(spark, "query_id long, text string", (1, "q"))
    assert ranked(ranking.rerank(base, queries, chunks, 2, lambda q, t: F.length(t))) == ["c1", "c0"]

    def model(batches):
        for pdf in batches:
            yield pdf.assign(score=pdf["text"].str.len().astype(float))

    assert ranked(ranking.rerank(base, queries, chunks, 1, model, batches=True)) == ["c1"]


def test_geo(spark):
    base = df(spark, "query_id long, rank int, chunk_id string, score double", *[(q, i + 1, c, s) for q in (1, 2) for i, (c, s) in enumerate([("far", 0.9), ("unlocated", 0.85), ("near", 0.8), ("filler", 0.0)])])
    places = df(spark, "query_id long, lat double, lon double, granularity string", (1, 45.99, 15.47, "town"), (2, 45.99, 15.47, "country"))
    points = df(spark, "chunk_id string, lat double, lon double", ("near", 45.98, 15.48), ("far", 46.42, 15.87))
    got = geo.geo_rerank(base, places, points, 3)
    assert ranked(got.where("query_id = 1")) == ["unlocated", "near", "far"]
    assert ranked(got.where("query_id = 2")) == ["far", "unlocated", "near"]


def test_chunks_are_handed_on_in_parts():
    import pyarrow as pa

    from lakequill.operators import chunking

    schema = pa.schema([(n, pa.int64() if n in ("size", "n", "tokens") else pa.string()) for n in (f.split()[0] for f in chunking.SCHEMA.split(", "))])
    texts = [f"# {i}\n" + "some words here. " * 3000 for i in range(60)]
    got = pa.RecordBatch.from_pydict({"id": [str(i) for i in range(60)], "title": ["t"] * 60, "text": texts})
    out = list(chunking._batches(schema, chunking.SIZES, chunking.count_units, iter([got])))
    assert len(out) > 5 and all(sum(map(len, b.column("text").to_pylist())) < 2 * chunking.HELD for b in out)
    want = [row for i, text in enumerate(texts) for row in chunking.chunks_of(str(i), "t", text)]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_range_join_of_rows_at_the_same_points(spark):
    rows = [(i, 45.0 + i % 3 / 100, 14.0) for i in range(60)] + [(60, None, 14.0)]
    a, p = df(spark, "anchor_id long, lat double, lon double", *rows), df(spark, "place_id long, lat double, lon double", *rows)
    found = geo.within(a, p, 1.2, digits=3)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and {x[:2] for x in got} == {(i, j) for i, _, _ in rows[:60] for j, _, _ in rows[:60] if i != j and abs(i % 3 - j % 3) <= 1}
    assert {x[2] for x in got} == {0.0, 1.112}
    assert found.rdd.getNumPartitions() > 1  # the rows come out of more than one task


def test_range_join_equals_cross_join(spark):
    import random

    rng = random.Random(2)
    rows = [(i, rng.uniform(-80, 80) if i % 3 else rng.uniform(45, 46), rng.uniform(-30, 30) if i % 3 else rng.uniform(10, 11)) for i in range(300)]
    a, p = df(spark, "anchor_id long, lat double, lon double", *rows), df(spark, "place_id long, lat double, lon double", *rows)
    for km in (5.0, 25.0, 400.0):
        got = {(r.anchor_id, r.place_id) for r in geo.within(a, p, km).collect()}
        far = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("p.lat"), F.col("p.lon"))
        want = {(r.anchor_id, r.place_id) for r in a.alias("a").crossJoin(p.alias("p")).where((far <= km) & (F.col("anchor_id") != F.col("place_id"))).collect()}
        assert got == want


def test_places_are_found_by_shared_words(spark):
    named = df(spark, "query_id long, place string", (1, "Old Town"), (2, "Nowhere"))
    gaz = df(spark, "place string, position int, place_id string, label string, lat double, lon double, is_person boolean", ("Old Town", 1, "p0", "Old Man", 1.0, 1.0, True), ("Old Town", 2, "p1", "Other", 1.0, 1.0, False), ("Old Town", 3, "p2", "town hall", 2.0, 3.0, None), ("Nowhere", 1, "p3", "Nowhere", None, None, False))
    assert [tuple(r) for r in geo.resolve(named, gaz).collect()] == [(1, "p2", 2.0, 3.0)]


def test_metrics(spark):
    qrels = df(spark, "question_id string, chunk_id string", ("q1", "a"), ("q1", "b"), ("q2", "c"))
    rows = df(spark, "query_id string, rank int, chunk_id string", ("q1", 1, "x"), ("q1", 2, "b"), ("q2", 1, "x"), ("q2", 2, "y"), ("q2", 3, "z"), ("q9", 1, "a"))
    m = evaluation.metrics(qrels, rows, (1, 5)).first()
    assert (m.hit_1, m.hit_5, m.recall_5, m.mrr_10, m.questions) == (0, 0.5, 0.25, 0.25, 2)
    assert evaluation.metrics(qrels, rows, (1,), mrr_k=1).first().mrr_1 == 0
    assert evaluation.metrics(qrels.limit(0), rows).first().hit_1 == 0.0
    chunks = df(spark, "id string, text string", ("x", "12345"), ("b", "123"))
    assert evaluation.chars_at_k(rows, chunks, 2).first().chars == pytest.approx((8 + 5 + 0) / 3)
    assert evaluation.chars_at_k(rows.limit(0), chunks).first().chars == 0.0


def test_evidence_falls_back_to_sentences(spark):
    chunks = df(spark, "chunk_id string, page_id string, text string", ("a", "p", "One  long sentence stands here. Short."), ("b", "p", "Another long sentence is here."), ("c", "q", "One long sentence stands here."))
    quote = lambda q: df(spark, "question_id string, page_id string, quote string", ("1", "p", q))
    ids = lambda q: sorted(r.chunk_id for r in evaluation.evidence(quote(q), chunks).collect())
    assert ids("One long\nsentence stands here.") == ["a"]
    assert ids("One long sentence stands here. Another long sentence is here.") == ["a", "b"]
    assert ids("Short. Gone.") == [] and ids("") == ["a", "b"]


def test_passages_equal_containment(spark):
    texts = ["aa bb cc dd ee ff gg hh", "xaa bb cc dd ee ff ggx hh", "bb cc", "zz aa bb cc dd ee ff gg", None, ""]
    passages = ["aa bb cc dd ee ff gg", "bb cc", "cc dd ee ff gg hh", "q"]
    got = {(r.question_id, r.chunk_id) for r in evaluation.passages_in(df(spark, "item_id long, text string", *enumerate(passages)), df(spark, "id long, text string", *enumerate(texts))).collect()}
    assert got == {(i, j) for i, p in enumerate(passages) for j, t in enumerate(texts) if t and p in t}


def test_sample_limit_zero_is_the_default(spark):
    rows = spark.range(2_500).select(F.col("id").alias("question_id"))
    assert evaluation.stable_sample(rows, 0).count() == 2_000 and evaluation.stable_sample(rows, 7).count() == 7


# Chunking

PAGE = "# Stadt\nEine Einleitung steht hier.\n\n## Geschichte\n[Bearbeiten | Quelltext bearbeiten]\nAlt.\n### Neuzeit\nNeu und mehr.\n\n## Weblinks\n[Bearbeiten | Quelltext bearbeiten]\n\n## Lage\n" + "Der Ort liegt an einem Fluss im Tal. " * 100


def test_chunks():
    rows = list(chunking.chunks_of("p", "Stadt", PAGE))
    small = [r for r in rows if r[2] == 256]
    assert all(r[7] <= r[2] + 50 and r[6].endswith(".") for r in rows)
    assert small[0][5] is None and "## Geschichte" in small[0][6] and {r[5] for r in small[1:]} == {"Lage"}
    assert not any("Bearbeiten" in r[6] or "Weblinks" in r[6] for r in rows)
    assert len([r for r in rows if r[2] == 2048]) == 1 and [r[3] for r in small] == list(range(len(small)))
    assert [c for c, _, _ in chunking.with_tiny_joined([("a", "x " * 60), (None, "Kurz.")], 256, chunking.count_units)] == ["a"]


def test_code_fences_hold_no_headings():
    page = chunking.Page("## A\n```\n# not a heading\n```\ntext\n#### deep\nmore", chunking.count_units)
    assert page.above == [["A"]] and "# not a heading" in page.texts[0] and "#### deep" in page.texts[0]


@given(st.lists(st.integers(1, 30), max_size=40), st.integers(5, 60))
def test_groups_equal_a_greedy_walk(costs, size):
    page = chunking.Page("", chunking.count_units)
    page.costs = costs
    want, used = [], None
    for i, c in enumerate(costs):
        if c > size or used is None or used + c + 1 > size:
            want.append([i])
            used = None if c > size else c + 1
        else:
            want[-1].append(i)
            used += c + 1
    assert [list(g) for g in page.groups(size)] == want


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n,!", max_size=600), st.integers(5, 60))
def test_pieces_make_the_text(text, size):
    pieces = chunking.split_to_size(text, size, chunking.count_units)
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(pieces)) == squeeze(text) and all(chunking.count_units(p) <= size for p in pieces)


def test_chunk_table(spark):
    got = chunking.chunk_pages(df(spark, "id string, title string, text string", ("a", "T", PAGE), ("b", "U", ""), ("c", None, None)), [256]).collect()
    assert {r.page_id for r in got} == {"a"} and got[0].id == "a:256:0"


# Stores


def test_carry_over(spark):
    schema = "id string, page_id string, size long, n long, title string, breadcrumb string, text string"
    old = df(spark, schema + ", role string, pos long", ("p:256:0", "p", 256, 0, "T", None, "same", "r1", 0), ("p:256:1", "p", 256, 1, "T", None, "gone", "r2", 1), ("p:256:2", "p", 256, 2, "T", "", "same", "r3", 2), ("p:512:0", "p", 512, 0, "T", None, "other size", "r4", 3))
    new = df(spark, schema, ("p:256:0", "p", 256, 0, "T", None, "same"), ("p:256:1", "p", 256, 1, "T", None, "new"), ("p:256:2", "p", 256, 2, "T", None, "other size"))
    assert {r.id: r.role for r in store.carry_over(new, old, ["role"]).collect()} == {"p:256:0": "r3", "p:256:1": None, "p:256:2": None}


def test_cache_and_done(spark):
    wanted = df(spark, "key string, ordinal long", ("a", 0), ("b", 1), ("a", 2), ("c", 3))
    cache = df(spark, "key string, value double", ("c", 3.0))
    misses = store.cache_misses(wanted, cache)
    assert sorted(r.key for r in misses.collect()) == ["a", "b"]
    computed = df(spark, "key string, value double", ("a", 1.0), ("b", 2.0))
    assert [r.value for r in store.cached(wanted, cache, computed).orderBy("ordinal").collect()] == [1.0, 2.0, 1.0, 3.0]
    done = df(spark, "key string, error string", ("a", None), ("b", "failed"))
    assert sorted(r.key for r in store.without_done(wanted, done, ["key"]).collect()) == ["b", "c"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=30))
def test_greedy_batches(costs):
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate(costs)], "key string, pos long, c long")
    got = {r.pos: r.batch for r in store.greedy_batches(rows, "key", "pos", F.col("c"), 4, 100).collect()}
    batch, n, used, want = 0, 0, 0, {}
    for i, c in enumerate(costs):
        if n and (n >= 4 or used + c > 100):
            batch, n, used = batch + 1, 0, 0
        want[i], n, used = batch, n + 1, used + c
    assert got == want


def test_numbered_batches(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("url"))
    got = store.numbered_batches(rows, rows.where("url % 10 = 0"), "url", 20, 3).collect()
    keys = sorted(r.url for r in got)
    assert {r.url: r.batch for r in got} == {k: 3 + i // 20 for i, k in enumerate(keys)} and len(keys) == 90


# Web

CARDS = "".join(f'<article><h2><a href="/events/{c}">{n}</a></h2><p>About {n} in town</p></article>' for c, n in zip("abcde", ("Concert", "Fair", "Play", "Talk", "Walk")))


@pytest.mark.parametrize(("html", "kind"), [("<article><h1>T</h1><p>Brestanica is a town with <a href='/x'>links</a> and <a href='/y'>more</a>.</p></article>", "prose"), ("<nav><a href='/a'>A</a></nav>", "empty"), ("<main><nav>Menu</nav><a href='/doc.PDF'>Report</a></main>", "prose"), ("<main><footer>x</footer></main>", "empty"), ("", "empty")])
def test_page_kinds(html, kind):
    row = web.extract_page("https://example.com/events", html)
    assert row[1] == kind
    if "Brestanica" in html:
        assert "Brestanica" in row[2]


def test_listing():
    url, root = "https://example.com/events", web.parsed(f"<html><body><main><p>Events</p>{CARDS}</main></body></html>")
    links = web.listing_links(root, url)
    assert len(links) == 5 and "- [Concert](https://example.com/events/a)" in web.listing_markdown(links)
    assert web.page_kind(root, url, "Events") == "listing" == web.page_kind(root, url, "") and web.page_kind(root, url, web.prose(root)) == "prose"


def test_documents_and_language():
    row = web.extract_page("https://example.com/a/", "<html lang='hu-HU'><title> T </title><main><p>Mail a@b.c tel 1</p><a href='x.pdf?y=1'>Plan</a><a href='x.pdf?y=1'>again</a></main><a href=z.pdf>out</a></html>")
    assert row[1] == "document" and row[5] == "hu" and row[6] == "T" and row[8] == [{"label": "Plan", "url": "https://example.com/a/x.pdf?y=1"}]


def test_markdown():
    md = web.to_markdown(web.parsed("<article><h2>A</h2><p>x <b>bold</b>\n y<p>z<ul><li>one<li>two</ul><script>no()</script></article>"))
    assert md == "## A\n\nx **bold** y\n\nz\n\n- one\n\n- two"


# Rules and catalog


def test_rule_flags(spark):
    pages = df(spark, "page_id string, title string, text string", ("p", "Castle Hill (Town)", "The castle was built in 1850 on a hill. " * 30))
    items = df(spark, "page_id string, n long, question string, query string, facts array<string>", ("p", 0, "When was the castle built there?", "castle built", ["built in 1850"]), ("p", 1, "When was the castle built there ?", "castle 1850", ["built in 1999"]), ("p", 2, "Who lives here?", "people", ["The castle"]))
    got = {r.n: r.flags for r in qa.rule_flags(items, pages).collect()}
    assert got == {0: [], 1: ["dup", "query_leak", "fact_unmatched"][:1] + ["fact_unmatched"], 2: ["no_anchor"]} or got[1] == ["dup", "fact_unmatched"]


def test_judges(spark):
    rows = df(spark, "id long, a boolean, x_ok boolean", (1, True, True), (1, True, False), (2, True, True), (3, None, True), (3, True, None))
    got = {r.id: (r.a, r.x_ok, r.answer_ok) for r in qa.judged_ok(rows, ["id"], ["a", "x_ok"]).collect()}
    assert got[1] == (True, False, True) and got[2] == (True, None, True) and got[3] == (True, True, True)


def test_catalog_names():
    names = list(catalog.catalog())
    assert len(names) == 38 == len(set(names)) and "sparse_hybrid" not in names and "qwen_hybrid_rerank_geo" in names
    assert catalog.resolve(None) == catalog.resolve([]) == list(catalog.DEFAULTS) and catalog.resolve(["all"]) == names
    with pytest.raises(ValueError, match="unknown methods: nope"):
        catalog.resolve(["nope"])


def test_methods_run(spark):
    chunks = df(spark, "id string, text string", ("Q1", "Canonical castle chunk."), ("Q2", "Canonical forest chunk."))
    vec = df(spark, "chunk_id string, vec array<float>", ("Q1", [1.0, 0.0]), ("Q2", [0.0, 1.0]))
    queries = df(spark, "query_id long, text string", (1, "castle history"), (2, "forest trail"))
    asked = df(spark, "query_id long, vec array<float>", (1, [1.0, 0.0]), (2, [0.0, 1.0]))
    places = df(spark, "query_id long, lat double, lon double, granularity string", (1, 45.0, 15.0, "site"))
    points = df(spark, "chunk_id string, lat double, lon double", ("Q1", 45.0, 15.0), ("Q2", 50.0, 15.0))
    corpus = catalog.Corpus(chunks, {"qwen": vec}, {"qwen": asked}, {}, places, points)
    for name in ("sparse", "sparse_rerank", "qwen", "qwen_hybrid", "qwen_hybrid_rerank", "qwen_hybrid_rerank_geo", "qwen_rerank_4b"):
        best = {r.query_id: r.chunk_id for r in catalog.retrieve(name, queries, corpus, 2).where("rank = 1").collect()}
        assert best == {1: "Q1", 2: "Q2"}, name
    catalog.ensure_ready(["qwen_hybrid"], corpus)
    for lacking in ({}, {"qwen": vec.limit(1)}):
        with pytest.raises(RuntimeError, match="index --method qwen"):
            catalog.ensure_ready(["qwen"], catalog.Corpus(chunks, lacking))


def stage_rows(spark, work):
    """Rows that the stages of work() shuffle."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    known = {stages().apply(i).stageId() for i in range(stages().size())}
    work()
    found = stages()
    return sum(found.apply(i).shuffleWriteRecords() for i in range(found.size()) if found.apply(i).stageId() not in known)


def test_bm25_pairs_are_no_rows(spark):
    """Every query shares a word with every document: neither the pairs nor the documents' postings are shuffled."""
    docs = df(spark, "id long, text string", *((i, f"common word{i} word{i + 1}") for i in range(400)), (400, None), (401, ""))
    queries = df(spark, "query_id long, text string", *((i, f"common word{i} word{i}") for i in range(300)))
    got = []
    assert stage_rows(spark, lambda: got.extend(sparse.bm25(queries, docs, 3).collect())) < 300 * 400 / 4
    first = {r.query_id: r.chunk_id for r in got if r["rank"] == 1}
    # word i stands in documents i - 1 and i: equal scores, the smaller id is first
    assert first == {i: max(0, i - 1) for i in range(300)} and len(got) == 900


def test_bm25_beyond_a_broadcast_and_in_many_blocks(spark, monkeypatch):
    docs = df(spark, "id string, text string", *((f"d{i:03}", " ".join(f"w{i * k % 37}" for k in range(1, 30))) for i in range(300)))
    queries = df(spark, "query_id long, text string", *((i, f"w{i % 37} w{i % 11} w{i % 11}") for i in range(80)))
    want = [(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in sparse.bm25(queries, docs, 5).orderBy("query_id", "rank").collect()]
    for name, value in (("BROADCAST_ROWS", 0), ("PRODUCTS", 7)):
        monkeypatch.setattr(sparse, name, value)
    got = [(r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in sparse.bm25(queries, docs, 5).orderBy("query_id", "rank").collect()]
    assert got == want and len(want) == 400


def test_passages_of_all_lengths_in_many_slices(spark, monkeypatch):
    """Shared windows, passages over the edge of a slice or of two texts, short, empty, repeated and null ones: as by `in`."""
    import random

    from lakequill.operators import passages

    monkeypatch.setattr(passages, "SLICE", 64)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "ab", "bä", "caaa", "aaaa", "日本"])
    texts = [" ".join(word() for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    asked = [t[a : a + rng.choice([1, 2, 3, 9, 31, 32, 40, 120])] for t in texts for a in (0, rng.randrange(0, 1 + len(t) // 2))] + ["a" * 33, "", "a a", texts[0] + texts[1]]
    quotes = sorted({q.encode() for q in asked})
    data = [t.encode() for t in texts]
    got = list(passages.occurrences(b"".join(data), np.cumsum([len(t) for t in data]), quotes))
    assert len(got) == len(set(got)) and set(got) == {(t, p) for t, text in enumerate(data) for p, q in enumerate(quotes) if q in text}
    found = evaluation.passages_in(df(spark, "item_id long, text string", (1, "aa  bb"), (2, " aa bb "), (3, None), (4, " "), (None, "bb")), df(spark, "id string, text string", ("x", "xaa\n bbx"), ("y", "a a"), ("z", None)), least=1)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "x"), (2, "x"), (None, "x")], key=str)


def test_passages_move_no_text(spark):
    docs = df(spark, "id long, text string", *((i, " ".join(f"w{i * k % 91}" for k in range(60))) for i in range(300)))
    assert stage_rows(spark, lambda: evaluation.passages_in(df(spark, "item_id long, text string", (0, "w5 w6 w7"), (1, "w7 w14 w21 w28 w35 w42 w49 w56 w63")), docs).collect()) < 100


def test_dense_cells_equal_double_precision():
    """Ties, differences below single precision, groups, numbers beyond it: as in double precision, of which few cells are computed."""
    rng = np.random.default_rng(4)
    held = rng.normal(size=(500, 48)).astype(np.float32)
    held[100:140] = held[:40]
    held[200] = held[7] + np.float32(1e-7)
    asked = held[::9].copy()
    for scale, k in ((1, 1), (1, 5), (1e-3, 3), (1e25, 1), (1, 600)):
        for other in (np.zeros((len(asked), len(held)), bool), (np.arange(len(asked)) % 3)[:, None] == (np.arange(len(held)) % 3)[None, :]):
            a, h = asked * np.float32(scale), held * np.float32(scale)
            want = dense._exact_cells(a.astype(np.float64) @ h.astype(np.float64).T, other, k)
            got = dense._cells(a, h, other, k)
            assert sorted(zip(*(x.tolist() for x in got[:2]))) == sorted(zip(*(x.tolist() for x in want[:2])))
            assert np.allclose(np.sort(got[2]), np.sort(want[2]), rtol=1e-12, atol=2e-9)
    same = np.ones((300, 4), np.float32)
    assert dense._cells(same, same, np.eye(300, dtype=bool), 1)[1].tolist() == [1, *[0] * 299]


@pytest.mark.parametrize("few", [True, False])
def test_dense_blocks_meet_apart_from_packing(spark, monkeypatch, few):
    """No task runs the Python that packs and the Python that multiplies; ranks, margins and the best are those of all pairs."""
    monkeypatch.setattr(dense, "ROWS", 7)
    monkeypatch.setattr(dense, "QUERIES", 5)
    monkeypatch.setattr(dense, "BROADCAST_ROWS", 1000 if few else 0)
    vecs = np.random.default_rng(6).integers(-3, 4, (60, 4)).astype(np.float32)
    chunks = df(spark, "chunk_id long, vec array<float>", *((i, v.tolist()) for i, v in enumerate(vecs)), (60, None))
    asked = chunks.where("chunk_id % 2 = 0").select(F.col("chunk_id").alias("query_id"), "vec", ((F.col("chunk_id") + 1) % 60).alias("own_id"))
    margins, best = dense.own_rank_margin(asked, chunks), dense.dense_top_k(asked.select("query_id", "vec"), chunks, 3)
    for found in (margins, best):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 3
        assert all("Exchange" in between for between in plan.split("MapInArrow")[1:-1])
    sims = vecs @ vecs.T
    want = []
    for q in range(0, 60, 2):
        others = np.delete(sims[q], q + 1)
        want.append((q, 1 + int((others > sims[q, q + 1]).sum()), float(sims[q, q + 1] - others.max())))
    assert [tuple(r) for r in margins.orderBy("query_id").collect()] == want
    assert ranked(best) == [int(i) for q in range(0, 60, 2) for i in np.lexsort((np.arange(60), -sims[q]))[:3]]


def test_dense_products_are_taken_in_slices():
    """Of a pair of large blocks no whole product is held: here it would take 400 MB."""
    import tracemalloc

    import pyarrow as pa

    n = 7_000
    vecs = np.random.default_rng(8).normal(size=(n, 8)).astype(np.float32)
    ids = np.arange(n)
    whole = lambda x: pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.array(x))
    data = pa.array([vecs.tobytes()], pa.binary())
    own = np.round((vecs.astype(np.float64) * np.roll(vecs, -1, 0)).sum(axis=1), 9)
    pair = pa.RecordBatch.from_arrays([whole(ids), data, whole(ids), data, whole((ids + 1) % n), whole(own)], ["ids", "data", "q_ids", "q_data", "q_own_id", "q_own"])
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
    for step in (dense._above, dense._best(1, False, schema)):
        tracemalloc.start()
        found = pa.Table.from_batches(step(iter([pair])))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found.column("query_id").to_pylist() == ids.tolist()
        assert most < 64 << 20


def test_distinctive_terms_shuffle_no_frequent_word(spark):
    """Words of many documents, by far the most rows, leave before the shuffles; the rest keep counts and first places."""
    common = " ".join(f"common{k}" for k in range(50))
    docs = df(spark, "id long, text string", *((i, f"{common} rare{i // 2} x1 12 Own{i} own{i} rare{i // 2} ab") for i in range(300)), (300, None))
    got = []
    rows = stage_rows(spark, lambda: got.extend(sparse.distinctive_terms(docs, 2).orderBy("id", "rank").collect()))
    assert [(r.id, r["rank"], r.term) for r in got] == [(i, k, t) for i in range(300) for k, t in ((1, f"own{i}"), (2, f"rare{i // 2}"))]
    assert rows < 300 * 50 / 2


def test_passages_beyond_a_broadcast(spark, monkeypatch):
    from lakequill.operators import passages

    docs = df(spark, "id long, text string", *((i, f"one two w{i} three") for i in range(50)))
    asked = df(spark, "item_id long, text string", *((i, f"two  w{i}") for i in range(30)))
    monkeypatch.setattr(passages, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(passages, "PASSAGES", 1)
    got = {(r.question_id, r.chunk_id) for r in evaluation.passages_in(asked, docs).collect()}
    assert got == {(i, j) for i in range(30) for j in range(50) if f"two w{i}" in f"one two w{j} three"}


def test_lex_overlap_shuffles_no_other_documents_words(spark):
    docs = df(spark, "id long, text string", *((i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(300)))
    pairs = df(spark, "query_id long, question string, id long", (1, "w7x1 w7x2 other", 7))
    got = []
    # Three words of equal weight (each in one document, or in none); beginnings of five letters: w7x1, w7x2, other.
    assert stage_rows(spark, lambda: got.extend(sparse.lex_overlap(pairs, docs).collect())) < 300 * 50 / 10
    assert [tuple(r) for r in got] == [(1, 0.667)]
