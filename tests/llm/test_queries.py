"""The registered queries and the pipeline on a small folder, against brute force or an independent library."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lakequill.llm import simhash
from lakequill.llm.queries import ORACLE, QUERIES, piece_model
from tests.llm.test_toxicity_simhash_suffix import brute_components, brute_cut, reference_hash


@pytest.fixture(scope="module")
def docs(sf):
    return {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def rows(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def test_thirteen_queries():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_op1(spark, sf, docs):
    got = rows(spark, sf, "op1_toxicity")
    assert {r.doc_id for r in got} == set(docs) and len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op2(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, sf, "op2_suffix_dedup")}
    ids = sorted(docs)
    assert got == dict(zip(ids, brute_cut([(docs[i]["text"] or "").encode() for i in ids], 400)))


def test_op4(spark, sf, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows(spark, sf, "op4_sentencepiece"):
        ids = sp.encode(docs[r.doc_id]["text"] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_op5(spark, sf):
    import html
    import re

    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    for r in rows(spark, sf, "op5_html_extraction"):
        source = pages[r.page_id]["html"]
        article = source[source.index("<article>") + 9 : source.rindex("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>|<br>(?=<p>|$)", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


def test_op7(spark, sf, docs):
    got = {r.doc_id: r for r in rows(spark, sf, "op7_simhash")}
    fps = {i: reference_hash(d["text"] or "") for i, d in docs.items()}
    comp = brute_components(sorted(set(fps.values())), 4)
    least: dict = {}
    for i, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


def test_op8(spark, sf, docs):
    got = rows(spark, sf, "op8_mixing")
    taken: dict = {}
    for r in got:
        s = docs[r.doc_id]["source"]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.size == len((docs[r.doc_id]["text"] or "").encode().split()) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[docs[r.doc_id]["source"]] - r.target) <= 1 for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows(spark, sf, "op8_mixing")))


def test_op9(spark, sf, docs):
    got = {r.doc_id: r for r in rows(spark, sf, "op9_fingerprints")}
    order = sorted(docs, reverse=True)
    for k, i in enumerate(order):
        text, following = docs[i]["text"] or "", docs[order[(k + 1) % len(order)]]["text"] or ""
        n = len(text)
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256((text[: n - n // 2] + following[: n // 2]).encode()).hexdigest()
    by: dict = {}
    for i in docs:
        by.setdefault(docs[i]["text"] or "", set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_pipeline_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on all that the one before it kept."""
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.collect()
        frame = stage(spark, frame, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == columns
            frame.write.parquet(out := str(tmp_path / str(k)))
            frame = spark.read.parquet(out)
        after = frame.collect()
        ids = [r.doc_id for r in after]
        if name == "toxicity":
            scores = {r.doc_id: r.predicted for r in rows(spark, sf, "op1_toxicity")}
            assert sorted(ids) == sorted(i for i, bad in scores.items() if not bad)
        elif name == "exact dedup":
            low = lambda t: (t or "").encode().lower()
            largest: dict = {}
            for r in before:
                largest[low(r.text)] = max(largest.get(low(r.text), -1), r.doc_id)
            assert sorted(ids) == sorted(largest.values())
        elif name == "simhash near-dedup":
            fps = {r.doc_id: reference_hash(r.text or "") for r in before}
            comp = brute_components(sorted(set(fps.values())), 4)
            least: dict = {}
            for i, f in fps.items():
                least[comp[f]] = min(least.get(comp[f], i), i)
            assert sorted(ids) == sorted(least.values())
        elif name == "mixing":
            assert {r.text for r in after} <= {r.text for r in before} and max(map(ids.count, set(ids))) <= 3
            assert abs(sum(len((r.text or "").split()) for r in after) / sum(len((r.text or "").split()) for r in before) - 1) < 0.2
        else:
            sentencepiece = pytest.importorskip("sentencepiece")
            sp = sentencepiece.SentencePieceProcessor(model_file=piece_model())
            texts = {r.doc_id: r.text for r in before}
            assert sorted(ids) == sorted(r.doc_id for r in before)
            assert all(list(r.ids) == sp.encode(texts[r.doc_id] or "", add_eos=True) for r in after)
    assert np.isfinite(len(after)) and simhash.BITS == 64


@pytest.mark.parametrize("rows", ["none", "some"])
def test_pipeline_stages_on_edge_rows(spark, tmp_path, rows):
    """Nulls in any column, empty and long texts, repeated rows and ids, no rows, and columns named as the stages' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __id long, __size string, __key int, __hash long, score double"
    extra = (None, "x", 1, 5, 0.5)
    data = [(1, "One text here", "en", "a", 13, *extra), (1, "One text here", "en", "a", 13, *extra), (1, "another text of the same id", None, None, None, *extra), (2, None, "de", "b", 0, *extra), (None, "", None, "a", None, *extra),
            (None, "ONE TEXT HERE", "fr", None, 1, *extra), (3, "long words " * 30_000, "en", "b", 1, *extra), (4, "idiot clown " * 4, "en", "c", 1, *extra), (5, "\x00 odd \U0001f600", "en", "c", 1, *extra)]
    frame = spark.createDataFrame(data if rows == "some" else [], schema)
    spark.createDataFrame([(1, 0, 1), (2, 0, 1), (3, 0, None), (5, 0, 1), (4, 1, 0), (None, 1, None), (3, None, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = frame.count()
        after = stage(spark, frame, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == frame.columns
            after.write.parquet(out := str(tmp_path / str(k)))
            frame = spark.read.schema(after.schema).parquet(out)
            assert frame.count() <= before or name == "mixing"
    ids = [r.doc_id for r in after.collect()]
    assert (not ids) if rows == "none" else {1, 3, 5} <= set(ids)
