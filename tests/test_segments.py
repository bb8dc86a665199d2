"""The stored BM25 index against BM25 over texts, its blocks, and segments that are added or lost."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lakequill.operators import segments, sparse, store


def ranked(df):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts of two vocabularies, with copies, empty and null texts; ids in no order."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((1, 5, 40)))) for vocabulary in ([f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]) for _ in range(150)]
    texts += texts[:20] + ["", None, "a1", "a1"]
    ids = rng.sample(range(1_000), len(texts))
    return spark.createDataFrame(list(zip(ids, texts)), "id bigint, text string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "a1 a2"), (2, "b3 b3 a4"), (3, "a1"), (4, "none here"), (5, ""), (6, None), (7, "b1 b2 b3 b4 b5 b6 b7 b8"), (None, "a1")], "query_id int, text string")


@pytest.mark.parametrize("limit,pairs,docs", [(10, 1 << 18, 64), (3, 4, 1_000), (400, 1 << 18, 130)])
def test_equals_plain_bm25(spark, corpus, asked, limit, pairs, docs):
    path = store.fresh_path(spark, "ix")
    english = corpus.text.startswith("a")
    for part in (corpus.where(english), corpus.where(~english | corpus.text.isNull())):
        segments.add_segments(part, path, most_docs=docs)
    known = asked.where("query_id is not null")
    assert ranked(segments.search(asked, segments.Index(spark, path), limit, most_pairs=pairs)) == ranked(sparse.bm25(known, corpus, limit))


def test_blocks_are_left_out(spark):
    """A query of one vocabulary reads no block of the other; short windows of good documents end the search early."""
    docs = [(i, "rose " * (1 + 30 * (i < 8)) + f"x{i % 5} y{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "id int, text string").coalesce(1)
    path = store.fresh_path(spark, "ix")
    segments.add_segments(df, path, window=8)
    counts = {}
    ask = spark.createDataFrame([("q", "rose")], "query_id string, text string")
    got = ranked(segments.search(ask, segments.Index(spark, path), 5, counts=counts))
    assert got == ranked(sparse.bm25(ask, df, 5)) and counts["pairs"] >= 40 and counts["scored"] < counts["pairs"] / 4


def test_a_segment_counts_once_its_manifest_row_is_written(spark, corpus, asked, monkeypatch):
    path = store.fresh_path(spark, "ix")
    first, second = corpus.where("id < 500"), corpus.where("id >= 500")
    segments.add_segments(first, path)
    before = ranked(segments.search(asked, segments.Index(spark, path), 5))
    files = {r["f"] for r in segments.Index(spark, path).rows.selectExpr("input_file_name() AS f").distinct().collect()}

    def lost(*_):
        raise RuntimeError("the driver died")

    with monkeypatch.context() as m:
        m.setattr(type(corpus), "coalesce", lost)  # after the segments, before the manifest
        with pytest.raises(RuntimeError):
            segments.add_segments(second, path)
    assert ranked(segments.search(asked, segments.Index(spark, path), 5)) == before
    segments.add_segments(second, path)
    after = segments.Index(spark, path)
    assert ranked(segments.search(asked, after, 5)) == ranked(sparse.bm25(asked.where("query_id is not null"), corpus, 5))
    assert files < {r["f"] for r in after.rows.selectExpr("input_file_name() AS f").distinct().collect()}  # older files are as they were


def test_files_follow_the_corpus(spark, corpus):
    for parts in (1, 3):
        path = store.fresh_path(spark, "ix")
        segments.add_segments(corpus.repartition(parts), path)
        assert segments.Index(spark, path).rows.selectExpr("input_file_name() AS f").distinct().count() == parts


def test_empty_corpus(spark, corpus, asked):
    path = store.fresh_path(spark, "ix")
    segments.add_segments(corpus.limit(0), path)
    index = segments.Index(spark, path)
    assert index.docs == 0 and segments.search(asked, index).collect() == []
    segments.add_segments(corpus, path)
    assert segments.search(asked.limit(0), segments.Index(spark, path)).collect() == []


def test_frontier_gives_the_exact_maximum():
    """Whatever the mean length, the best pair of a block is among those kept."""
    rng = np.random.default_rng(2)
    lists = [["t"] * int(rng.integers(1, 9)) + ["u"] * int(rng.integers(0, 200)) for _ in range(300)]
    kinds = {"segment": pa.int64(), "window": pa.int32(), "term": pa.string(), "n": pa.int32(), "total": pa.int64(), **{c: pa.list_(pa.int32()) for c in ("gaps", "tfs", "best_tfs", "best_lengths")}, "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32())}
    rows = segments._segment(7, pa.array(range(300)), pa.array(lists), pa.schema(list(kinds.items()))).to_pylist()
    lengths = {r["window"]: r["lengths"] for r in rows if r["term"] is None}
    assert sorted(i for r in rows if r["term"] is None for i in r["ids"]) == list(range(300))
    for r in (r for r in rows if r["term"]):
        spots = np.cumsum(r["gaps"])
        for mean in (5.0, 80.0, 500.0):
            own = max(segments._saturation(mean, 1.5, 0.75, f, lengths[r["window"]][s]) for f, s in zip(r["tfs"], spots))
            assert own == max(segments._saturation(mean, 1.5, 0.75, f, length) for f, length in zip(r["best_tfs"], r["best_lengths"]))


def test_a_segment_closes_inside_a_batch(monkeypatch):
    """One batch of many documents is many segments: a task holds no more than most_tokens and a document."""
    import types

    import pyarrow as pa

    from lakequill.operators import segments

    monkeypatch.setattr(segments, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 0)))
    seen = []
    monkeypatch.setattr(segments, "_segment", lambda number, ids, lists, schema, width: seen.append((ids.to_pylist(), len(lists.flatten()))) or pa.RecordBatch.from_pydict({"x": [1]}))
    got = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([["a"] * 50] * 1000)], ["id", "tokens"])
    for parts in ([got], [got.slice(0, 300), got.slice(300)]):
        seen.clear()
        list(segments._segments(None, 10_000, 500, 128, iter(parts)))
        assert [i for ids, _ in seen for i in ids] == list(range(1000)) and max(n for _, n in seen) <= 550
