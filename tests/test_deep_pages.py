"""Pages nested without bound, unmatched tags, models named by settings."""

from __future__ import annotations

import time

from lakequill import models
from lakequill.operators import web


def test_deeply_nested_pages_are_read():
    deep = 20_000
    page = "<html><body><main>" + "<div>" * deep + "<p>The text at the bottom of the page stands here.</p>" + "</div>" * deep + "<p>After <b>it</b> all.</p></main></body></html>"
    began = time.perf_counter()
    row = web.extract_page("https://example.com/a/", page)
    assert row[-1] is None and row[2] == "The text at the bottom of the page stands here.\n\nAfter **it** all."
    assert time.perf_counter() - began < 20


def test_end_tags_that_match_nothing_cost_nothing():
    began = time.perf_counter()
    root = web.parsed("<div>" * 5_000 + "</span>" * 50_000 + "text")
    assert root.text() == "text" and time.perf_counter() - began < 10


def test_above_holds_all_names_around():
    root = web.parsed("<main><div><nav><div><a href=x>y</a></div></nav></div><p>z</p></main>")
    at = {n.name: n for n in root.walk()}
    assert at["a"].inside(("nav",)) and at["a"].inside(frozenset({"main"})) and not at["p"].inside(("nav", "div")) and not at["main"].inside(("main",))


def test_items_keep_their_marks_in_nested_blocks():
    md = web.to_markdown(web.parsed("<ul><li>one<p>more</p></li><li><div>two</div></li></ul><blockquote><p>said</p></blockquote>"))
    assert md == "- one\n\n- more\n\n- two\n\n> said"  # as before, when it was recursive


def test_links_of_nested_boxes_in_linear_time():
    deep = 3_000
    chain = "<div>" * deep + "<a href='x{0}'>Title {0}</a> and some more words" + "</div>" * deep
    began = time.perf_counter()
    root = web.parsed("<main>" + "".join(chain.format(i) for i in range(6)) + "</main>")
    assert [x["label"] for x in web.listing_links(root, "https://e.org/")] == [f"Title {i}" for i in range(6)]
    assert time.perf_counter() - began < 10


def test_settings_name_models_and_reports_name_stand_ins():
    found = models.named({"embedders": {"qwen": "lakequill.operators.dense:hashing_embedder"}}, "embedders")
    assert found["qwen"]()(__import__("pandas").Series(["a"])).iloc[0] and models.named({}, "rerankers") == {}
    notes = models.stand_ins(["sparse", "qwen_rerank", "qwen_hybrid_rerank_4b", "qwen_hybrid_rerank_geo"], ["qwen", "nemotron"], found, {"_4b": max})
    assert [n.split(":")[0] for n in notes] == ["nemotron", "qwen_rerank, qwen_hybrid_rerank_geo"]
    assert models.stand_ins(["sparse"], [], {}, {}) == []
