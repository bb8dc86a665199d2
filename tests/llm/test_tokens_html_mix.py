from __future__ import annotations

import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakequill.llm import mixing
from lakequill.llm.html_extract import extract, main_text
from lakequill.llm.queries import piece_model
from lakequill.llm.sentencepiece_bpe import Vocabulary, decode, encode

ALPHABET = "abcdef ▁\n\t\r\x00éßœ日本語한😀́'\".,;:(){}<>/s0123456789aaaa  "


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def vocab():
    return Vocabulary(piece_model())


def ids_of(vocab, texts):
    import numpy as np

    return [np.frombuffer(x, np.int32).tolist() for x in vocab.encode_batch(texts)]


def test_encoding_equals_the_library(vocab, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(2_000)]
    texts += ["".join(rng.choice(string.printable) for _ in range(200)) for _ in range(300)]
    texts += ["", "a" * 20_000, " " * 300, "▁▁ ▁", "<s>", "</s><0x41>", "ab" * 5_000]
    want = library.encode(texts, add_eos=True)
    assert ids_of(vocab, texts) == want
    assert [vocab.decode(x) for x in want] == library.decode(want)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=40))
def test_any_text(text):
    vocab = _once()
    sp = _library()
    assert ids_of(vocab, [text])[0] == sp.encode(text, add_eos=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 300), max_size=12))
def test_any_ids(ids):
    assert _once().decode(ids) == _library().decode(ids)


def _once(held=[]):  # noqa: B006
    held or held.append(Vocabulary(piece_model()))
    return held[0]


def _library(held=[]):  # noqa: B006
    import sentencepiece

    held or held.append(sentencepiece.SentencePieceProcessor(model_file=piece_model()))
    return held[0]


def test_encode_and_decode_tables(spark):
    df = spark.createDataFrame([(1, "Hello  world", 0), (2, None, 0), (2, "", 0), (None, "ä" * 50_000, 0)], "doc_id long, text string, ids int")
    rows = encode(df, piece_model(), decoded=True).collect()
    assert sorted(len(r.ids) for r in rows)[:2] == [1, 1] and all(r.ids[-1] == 2 for r in rows)
    back = decode(encode(df, piece_model()), piece_model()).collect()
    assert sorted(r.text for r in back) == sorted(["Hello  world", "", "", "ä" * 50_000]) == sorted(r.decoded for r in rows)
    assert encode(df.limit(0), piece_model()).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href=/a>Menu</a></ul></nav><div class="cookie-notice">We use cookies on this page, as you know.</div>
%s<aside>Side</aside><div id="comments"><p>A reader's comment that is long enough to look like text.</p></div>
<form><label>Name</label><input></form><footer>&copy; 2024</footer></body></html>"""
BODY = "<h1>A &amp; B</h1><p>First   para\ngraph &eacute; with <b>bold</b> and <a href=x>a link</a>.<p>Second one, rather long, so that it is text.<br>Same block.<ul><li>Item one<li>Item two</ul><p>Ok.</p>"
TEXT = "A & B\nFirst para graph é with bold and a link.\nSecond one, rather long, so that it is text. Same block.\nItem one\nItem two\nOk."


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><article>%s</article></main>", "<div role=main>%s</div>", "<div class=content><div>%s</div></div>"])
def test_main_text(wrap):
    assert main_text(PAGE % (wrap % BODY)) == TEXT


LONG = "A paragraph that is long enough to be text, with several words in it and an end. " * 3


def test_smoothing_decides():
    """A lone box with a long line among short ones isn't content; a short block among long ones is. Without the Gaussian both go wrong."""
    box = "<div><div>Win</div><div>a</div><div>prize</div><div>Call us at any time of the day or night for offers.</div><div>or</div><div>ask</div><div>us</div></div>"
    body = "<div>" + "".join(f"<p>{LONG}{i}</p><div>So {i}.</div>" for i in range(4)) + "</div>"
    want = "\n".join(f"{LONG}{i}\nSo {i}." for i in range(4))
    page = f"<html><body>{box}{body}</body></html>"
    assert main_text(page) == want
    import lakequill.llm.html_extract as H

    held, H.smoothed = H.smoothed, lambda values: values
    try:
        assert main_text(page) != want
    finally:
        H.smoothed = held


def test_two_articles_and_linked_paragraphs():
    linked = '<p><a href="x">A paragraph that is a link from its start to its end, as some are.</a></p>'
    one, two = (f"<article><h2>Title {n}</h2><p>{LONG}{n}</p>{linked if n == 1 else ''}<p>{LONG}!</p></article>" for n in (1, 2))
    text = main_text(f"<body><nav><a>Menu</a></nav><main>{one}{two}</main><footer>Foot</footer></body>").split("\n")
    assert text == ["Title 1", f"{LONG}1", "A paragraph that is a link from its start to its end, as some are.", f"{LONG}!", "Title 2", f"{LONG}2", f"{LONG}!"]


@pytest.mark.parametrize("names", ["article", "div", "section", "main"])
def test_given_pages_without_the_tag(sf, names):
    """The given pages, brute force by their blocks; the article element is renamed, so no tag name decides."""
    import html
    import re

    import pyarrow.parquet as pq

    for r in pq.read_table(f"{sf}/pages.parquet").to_pylist():
        article = r["html"][r["html"].index("<article>") + 9 : r["html"].rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>(?=<p>|$)", article)]
        assert main_text(r["html"].replace("<article>", f"<{names}>").replace("</article>", f"</{names}>")) == "\n".join(b for b in blocks if b)


def test_pages_without_text(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "<nav>a</nav>", "x"), (3, "v", PAGE % ("<article>" + "<p>word</p>" * 20_000 + "</article>"), "x")], "page_id long, url string, html string, text string")
    rows = sorted(extract(df).collect(), key=lambda r: r.n_chars)
    assert [r.n_chars for r in rows] == [0, 0, 0, 5 * 20_000 - 1] and rows[0].text == ""
    assert extract(df.limit(0)).count() == 0


def filled(sizes: dict, weights=mixing.WEIGHTS, most=3.0):
    """Reshare the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, out = float(sum(sizes.values())), {}
    open_ = list(order)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s] + 1e-9]
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        open_ = [s for s in open_ if s not in over]
    return out


def mixed(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    return mixing.mix(df, **options)


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_A_SLICE", 5)
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a", "b", "c", "d", "é", "Z", None, "a", "a"]), 1) for i in range(600)]
    rows += [(1000, "tiny", "few", 1), (1001, None, "few", 1), (1002, "", "none", 1), (None, "null id here", "a", 1), (5, "same row", "b", 1), (5, "same row", "b", 1)]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    taken: dict = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["__size"]
        taken[r.source] = taken.get(r.source, 0) + r["__taken"]
        assert 0 <= r["__taken"] <= 3 * r["__size"] and r["__size"] == len((r.text or "").split())
    want = filled(sizes)
    for r in got:
        assert r["__target"] == pytest.approx(want[r.source]) and r["__source_size"] == sizes[r.source]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2
    again = mixed(spark, rows[::-1]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def brute_mix(rows, seed=8):
    """Words taken of each row: targets reshared step by step, then a sort of each source by its keys."""
    import hashlib
    import math
    import unicodedata

    size = lambda t: len((t or "").encode().split())
    sizes: dict = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    targets = filled(sizes)

    def order(row):
        doc_id, t, _, _ = row
        t = t or ""
        tie = hashlib.md5(f"{seed}|{'' if doc_id is None else doc_id}|{t}".encode()).hexdigest()
        share = sum(unicodedata.category(c)[0] in "LM" or c in " \t\n\x0b\f\r" for c in t) / len(t) if t else 0.1
        return -math.log((int(tie[:13], 16) + 0.5) / 2**52) / max(0.01, share * share), tie, size(t)

    taken = {}
    for s in sizes:
        goal = math.floor(targets[s] + 0.5)
        epochs = goal // sizes[s] if sizes[s] else 0
        left = goal - epochs * sizes[s]
        for row in sorted((r for r in rows if r[2] == s), key=order):
            part = min(left, size(row[1]))
            taken[row] = epochs * size(row[1]) + part
            left -= part
    return taken, targets, sizes


def test_rest_that_rounds_to_a_whole_source(spark):
    rows = [(100 * k + i, f"w{i}", s, 1) for k, (s, n) in enumerate({"a": 20, "b": 10, "c": 9}.items()) for i in range(n)]
    got = mixed(spark, rows).collect()
    taken = {s: sum(r["__taken"] for r in got if r.source == s) for s in "abc"}
    assert {r.source: r["__target"] for r in got}["b"] == 9.75 and taken["b"] == 10


@pytest.mark.parametrize("seed", range(8))
def test_mix_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "ROWS_A_SLICE", 4)
    rng = random.Random(seed)
    names = rng.sample(["a", "B", "é", "z", "y", None, "ä"], rng.randrange(1, 8))
    rows = [(i, " ".join(rng.choice(["w", "w2", "é!", "3-4"]) for _ in range(rng.randrange(0, 1 + 3 ** rng.randrange(4)))), s, 1) for i, s in enumerate(rng.choices(names, [3.0**k for k in range(len(names))], k=rng.randrange(1, 80)))]
    taken, targets, sizes = brute_mix(rows)
    got = mixed(spark, rows).collect()
    assert {(r.doc_id, r.text, r.source, 1): r["__taken"] for r in got} == taken
    for s, size in sizes.items():
        assert abs(sum(n for r, n in taken.items() if r[2] == s) - targets[s]) <= 1
    for r in got:
        assert r["__target"] == pytest.approx(targets[r.source]) and r["__source_size"] == sizes[r.source]


def test_mix_takes_whole_epochs_first(spark):
    rows = [(i, "w " * 10, s, 1) for i, s in enumerate(["a"] * 20 + ["b"] * 40 + ["c"] * 20)]
    got = mixed(spark, rows).collect()
    for s in "abc":
        own = [r for r in got if r.source == s]
        epochs = int(own[0]["__target"] // own[0]["__source_size"])
        assert all(epochs * 10 <= r["__taken"] <= (epochs + 1) * 10 for r in own)


def test_mixed_rows_and_empty(spark):
    df = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(["a"] * 20 + ["b"] * 40)], "doc_id long, text string, source string")
    rows = mixing.mixed_rows(df)
    assert rows.columns == df.columns
    n = {r.source: r["count"] for r in rows.groupBy("source").count().collect()}
    assert abs(10 * n["a"] - filled({"a": 200, "b": 400})["a"]) <= 5
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("cut", ["<!-- never closed " + "x " * 50, "<a href='x' title=\"" + "y " * 50, "<p class=z", "</div", "<!doctype", "<?php echo"])
def test_markup_that_the_end_cuts_off_shows_nothing(cut):
    body = "<article><h1>Title</h1><p>" + "A sentence of the article stands here. " * 5 + "</p>"
    assert main_text(body + cut) == main_text(body + "</article>") != ""


def test_long_unclosed_markup_takes_linear_time():
    import time

    for start in ("<a ", "<!-- "):
        began = time.perf_counter()
        text = main_text("<p>" + "Words of the text come first. " * 10 + "</p>" + start + "data-x='1' " * 600_000)
        assert text.startswith("Words of the text") and len(text) < 400 and time.perf_counter() - began < 10


def test_headers_and_sections_of_the_article_stay():
    text = "A long paragraph of the article, with many words in it. " * 4
    page = f"<nav>menu</nav><article><div class='article-header'><h1>The title</h1></div><p>{text}</p><section class='related-work'><p>{text}</p></section><div class='related-posts'><p>{text}</p></div></article>"
    assert main_text(page).split("\n") == ["The title", text.strip(), text.strip()]
