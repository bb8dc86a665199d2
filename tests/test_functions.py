from __future__ import annotations

import re

import uuid
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakequill.functions import geo, ids, vectors
from lakequill.functions import text as T
from lakequill.operators.quotes import Plain, quote_spans, tables


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


NUMBERS = [("1 234,5 m", 1234.5), ("1,234.5", 1234.5), ("~120[3]", 120.0), ("12,5", 12.5), ("1.234", 1234.0), ("n/a", None), ("1.234.567", 1234567.0), ("-3,25*", -3.25), ("1,234", 1234.0), ("1.5", 1.5), ("1'000", 1000.0), ("", None), ("12.", 12.0)]


@pytest.mark.parametrize(("cell", "value"), NUMBERS)
def test_numbers(spark, cell, value):
    assert one(spark, T.number(F.col("s")), s=cell) == value


def parse_number(cell):
    """The rules of T.number, digit by digit."""
    m = re.search(r"-?[0-9][0-9 .,]*", cell)
    s = m[0].replace(" ", "").rstrip(".,") if m else ""
    last = max(s.rfind("."), s.rfind(","))
    if last >= 0:
        mark, behind = s[last], len(s) - last - 1
        two = "." in s and "," in s
        alone = s.count(mark) == 1
        decimal = two or alone and (behind <= 2 if mark == "," else not (behind == 3 and len(s.lstrip("-")) - 4 <= 3))
        s = s[:last].replace(".", "").replace(",", "") + ("." if decimal else "") + s[last + 1 :]
    try:
        return float(s)
    except ValueError:
        return None


def test_all_numbers_agree(spark):
    cells = [f"{a}{b}{c}{d}{e}" for a in ("1", "12", "-123") for b in ("", ".", ",", " ") for c in ("2", "345", "34") for d in ("", ".", ",") for e in ("", "6", "78", "901")]
    got = {r.s: r.x for r in spark.createDataFrame([(c,) for c in cells], "s string").select("s", T.number(F.col("s")).alias("x")).collect()}
    assert got == {c: parse_number(c) for c in cells}


def test_text_rules(spark):
    assert one(spark, T.tokens(F.col("s")), s="Ab_c dÉ9 x") == ["ab", "c", "dé9", "x"]
    assert one(spark, T.words(F.col("s")), s="Ab_c dÉ9 x") == ["ab_c", "dé9", "x"]
    assert one(spark, T.question_norm(F.col("s")), s=" What's  THIS? ") == "what s this"
    assert one(spark, T.title_norm(F.col("s")), s="Lake One (Sweden)") == "lake one"
    assert sorted(one(spark, T.stems(F.col("s")), s="castles 12345 a castle wall")) == ["cast", "wall"]
    assert sorted(one(spark, T.numbers_in(F.col("s")), s="1 416 and 1416, 3.14 of 12,345")) == ["12345", "14", "1416", "3"]
    assert one(spark, T.sentences(F.col("s")), s="One. Two! Three? x.y") == ["One.", "Two!", "Three?", "x.y"]
    assert one(spark, T.represent(F.col("a"), F.col("b"), F.col("c")), a="t", b="", c="x") == "t\nx"
    assert one(spark, T.markdown_clean(F.col("s")), s="\n a \r\n\n\n\nWe use Cookies\n b\n\n") == "a\n\nb"
    assert one(spark, T.without_edit_links(F.col("s")), s="A[Bearbeiten | Quelltext bearbeiten] b") == "A b"
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)
    assert one(spark, T.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0
    assert one(spark, T.cells(F.col("s")), s="| a | *b*[1] | |") == ["a", "b", ""]
    assert one(spark, T.number_leak(F.col("q"), F.col("f"), F.col("s")), q="since 1850", f=["built 1850"], s="When?") is True
    assert one(spark, T.number_leak(F.col("q"), F.col("f"), F.col("s")), q="since 1850", f=["built 1850"], s="Was it 1850?") is False


def test_capped(spark):
    cap = lambda s, k, n=300: one(spark, T.capped(F.col("s"), k, n), s=s)
    assert cap("One is. Two is. Three.", 2) == "One is. Two is."
    assert cap("One is here. Two is there.", 2, 15) == "One is here."
    assert cap("word " * 100, 1, 20) == "word word word…"
    assert cap("“Quoted one.” ", 1) == "Quoted one."


def test_page_rules(spark):
    assert one(spark, T.needs_render(F.col("s")), s="Please  enable\nJavaScript") is True
    assert one(spark, T.contact_footer(F.col("s")), s="Mail a@b.c, Tel 1") is True
    assert one(spark, T.html_language(F.col("s")), s='<!doctype html><HTML class=x lang="hu-HU">') == "hu"
    assert one(spark, T.html_language(F.col("s")), s='<html><meta http-equiv="Content-Language" content="de_AT">') == "de"
    assert one(spark, T.html_language(F.col("s")), s="<html>") is None
    assert one(spark, T.html_title(F.col("s")), s="<title>\n A &amp; B </title>") == "A & B"
    assert one(spark, T.response_error(F.col("n"), F.col("t"), F.col("s")), n=503, t="text/html", s="") == "http 503"
    assert one(spark, T.response_error(F.col("n"), F.col("t"), F.col("s")), n=200, t="text/HTML", s="ok") is None
    assert one(spark, T.is_child_page(F.col("a"), F.col("b")), a="https://x.org/e/", b="https://x.org/e/1") is True
    assert one(spark, T.is_child_page(F.col("a"), F.col("b")), a="https://x.org/e", b="https://y.org/e/1") is False
    assert one(spark, T.language_ok(F.col("a"), F.col("b"), F.col("c")), a="sv", b="sv", c="https://sv.wikipedia.org/wiki/X") is True


def test_identities(spark):
    url = "https://example.com/ä?x=1"
    assert one(spark, ids.uuid5_url(F.col("s")), s=url) == str(uuid.uuid5(uuid.NAMESPACE_URL, url))
    assert one(spark, ids.crc(F.col("s")), s="Q123") == 637275419 == zlib.crc32(b"Q123")
    assert one(spark, ids.page_of_chunk(F.col("s")), s="a:b/Q1:512:0") == "a:b/Q1"
    assert one(spark, ids.qrel_key(F.lit("p"), F.col("s")), s="why?") == f"p|{zlib.crc32(b'why?'):08x}"
    assert one(spark, ids.pick(F.col("s"), F.lit("k")), s=["a", "b", "c"]) == "abc"[zlib.crc32(b"k") % 3]
    assert one(spark, ids.pick(F.col("s"), F.lit("k")), s=[]) is None


def test_geo_and_vectors(spark):
    km = one(spark, geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")), a=45.99, b=15.47, c=46.42, d=15.87)
    assert km == pytest.approx(57.0, abs=1)
    df = spark.createDataFrame([([3.0, 4.0],), ([float("nan"), 1.0],), (None,)], "v array<double>")
    rows = df.select(vectors.missing(F.col("v")).alias("m"), vectors.norm(F.col("v")).alias("n"), vectors.shortened(F.col("v"), 1).alias("s")).collect()
    assert [r.m for r in rows] == [False, True, True] and rows[0].n == 5 and rows[0].s == [1.0]


def test_quotes():
    text = "**Old** castle[1] of\n the  *town*. Next."
    assert Plain(text).text == "Old castle of the town. Next."
    spans, ok = quote_spans(text, ["castle of the town", "Old castle"])
    assert ok and [text[a:b] for a, b in spans] == ["castle[1] of\n the  *town", "Old** castle"]
    assert quote_spans(text, ["absent"]) == ([], False) and quote_spans(text, [""])[1] is False


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab *[1]\n", max_size=40))
def test_plain_offsets(s):
    plain = Plain(s)
    assert all(s[plain.place(i)] == c or c == " " and s[plain.place(i)].isspace() for i, c in enumerate(plain.text))
    assert plain.text == re.sub(r"\s+", " ", re.sub(r"\*+|\[\d+\]", "", s))


def test_pipe_tables(spark):
    rows = "\n".join(f"| r{i} | {i},5 | x{i} |" for i in range(5))
    found = one(spark, tables(F.col("s")), s=f"before\n| name | size | note |\n|---|:-:|---|\n{rows}\nafter\n | a | b |\n|---|---|\n| 1 | 2 |")
    assert len(found) == 1 and found[0].header == ["name", "size", "note"] and [r[1] for r in found[0].rows] == [f"{i},5" for i in range(5)] and 1 in found[0].numeric
    assert one(spark, tables(F.col("s")), s="| a | b |\n|---|---|\n| 1 | 2 |") == [] == one(spark, tables(F.col("s")), s="")
    wide = "\n".join(["|a|b|", "|-|-|", *(f"|x|{i}|" for i in range(20_000))])
    assert len(one(spark, tables(F.col("s")), s=wide)[0].rows) == 20_000
