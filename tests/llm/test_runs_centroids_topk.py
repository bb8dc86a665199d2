"""Periodic runs, centroid clustering and exact top-k search against brute force."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakequill.llm import centroids, threshold_search
from lakequill.llm.centroids import centroid_clusters, nearest, segment_norms
from lakequill.llm.integer_vectors import MOST
from lakequill.llm.periodic_runs import periodic_runs, smallest_periods, stretches, without_repeats, word_numbers
from lakequill.llm.queries import QUERIES
from lakequill.llm.threshold_search import Asked, parts_of, top_inner_products

NAN, INF = float("nan"), float("inf")


def brute_runs(words, least=24, exponent=3):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def kernel(words, least, exponent):
    found = stretches(word_numbers([w.encode() for w in words]), 1, len(words) // exponent + 1, least, exponent)
    return [tuple(r) for r in smallest_periods(found).tolist()]


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_run_kernel(data):
    words = data.draw(st.lists(st.sampled_from("abc"), max_size=70))
    if words and data.draw(st.booleans()):
        at, period = data.draw(st.integers(0, len(words) - 1)), data.draw(st.integers(1, 12))
        words = [words[i] if i < at else words[at + (i - at) % period] if at + (i - at) % period < len(words) else "z" for i in range(len(words))]
    least, exponent = data.draw(st.integers(1, 24)), data.draw(st.integers(2, 4))
    assert kernel(words, least, exponent) == brute_runs(words, least, exponent)


def test_run_kernel_blocks_and_ranges():
    words = [str(i % 7) for i in range(3_000)] + [str(i * i % 101) for i in range(3_000)]
    ids = word_numbers([w.encode() for w in words])
    whole = smallest_periods(stretches(ids, 1, 2_001, 24, 3))
    split = smallest_periods(np.concatenate([stretches(ids, low, min(low + 333, 2_001), 24, 3) for low in range(1, 2_001, 333)]))
    assert np.array_equal(whole, split) and len(whole) >= 2
    assert without_repeats([w.encode() for w in words], whole).decode() == brute_kept(words, whole.tolist())
    many = np.arange(70_000).astype(np.int32)  # more words than fit 16 bits
    assert word_numbers([str(i).encode() for i in many]).dtype == np.int32


def test_periodic_runs_edges(spark):
    long = " ".join(["alpha beta gamma"] * 40 + [f"w{i}" for i in range(60)])
    texts = ["", None, " \t\n", "one", "a " * 23, "a " * 24, "x y " * 30, long, long, "a b " * 11 + "a", "z " * 5_000, " " * 50]
    rows = [(i // 2 if i < 8 else None, t, "r", "k", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, kept string, `a.b` int")
    for limit in (65_536, 100, 0):  # in place, and by ranges of shifts
        got = {r["a.b"]: r for r in periodic_runs(docs, long=limit).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            words = [w.decode() for w in (t or "").encode().split()]
            want = brute_runs(words)
            assert [tuple(x) for x in got[i]["runs"]] == want and got[i]["kept"] == brute_kept(words, want), (limit, i)
            assert (got[i].doc_id, got[i].text) == rows[i][:2]
    assert periodic_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(docs, exponent=1)


def test_periodic_runs_many_ranges(spark, monkeypatch):
    """A text whose shifts are dealt out into many ranges."""
    from lakequill.llm import periodic_runs as module

    monkeypatch.setattr(module, "RANGE_CELLS", 1_000)
    monkeypatch.setattr(module, "MOST_RANGES", 7)
    words = [str(i % 11) for i in range(300)] + [str(i * 7 % 13 + i // 100) for i in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id int, text string")
    got = periodic_runs(docs, long=10).first()
    assert [tuple(x) for x in got.runs] == brute_runs(words)


def test_op11(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    got = QUERIES["op11_periodic_runs"](spark, sf).collect()
    assert len(got) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    planted = 0
    for r in got:
        words = [w.decode() for w in (docs[r.doc_id] or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(words) if n < 700 else kernel(words, 24, 3)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)) and r.collapsed_sha256 == sha(brute_kept(words, runs))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, best[1] * 1000 // best[2] if best[0] is not None else None)
    assert planted > 5


def brute_clusters(vectors, first, rounds):
    """Plain integer k-means."""
    centres = [list(vectors[i]) for i in first]
    dist = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    pick = lambda x: min(range(len(centres)), key=lambda j: (dist(x, centres[j]), j))
    for _ in range(rounds):
        own = [pick(x) for x in vectors]
        for j in range(len(centres)):
            members = [x for x, c in zip(vectors, own) if c == j]
            if members:
                centres[j] = [sum(col) // len(members) for col in zip(*members)]
    own = [pick(x) for x in vectors]
    return own, [dist(x, centres[c]) for x, c in zip(vectors, own)], centres


def test_screening_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (16, 64))
    vectors = centres[rng.integers(0, 16, 500)] + rng.integers(-5, 6, (500, 64))
    vectors[:3] = 0
    centres[5] = centres[2]  # a tie goes to the smaller number
    cluster, distance, computed = nearest(vectors, segment_norms(vectors), centres, segment_norms(centres))
    every = np.square(vectors[:, None, :] - centres[None]).sum(axis=2)
    assert np.array_equal(cluster, every.argmin(axis=1)) and np.array_equal(distance, every.min(axis=1))
    assert computed < 500 * 16 * 0.6


def test_op12(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    rows = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(range(len(rows)), key=lambda i: hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest())[:16]
    own, distance, centres = brute_clusters([v for _, v in rows], first, 3)
    sums = [sum(d for d, c in zip(distance, own) if c == j) for j in range(16)]
    want = {i: (c, d, sums[c], sum(sums), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for (i, _), c, d in zip(rows, own, distance)}
    got = {r.vec_id: tuple(r)[1:] for r in QUERIES["op12_centroid_clustering"](spark, sf).collect()}
    assert got == want


def test_clusters_edges(spark):
    vectors = [(1, [0.5, 1.0, -1.0]), (1, [0.5, 1.0, -1.0]), (None, [9.0, 9.0, 9.0]), (2, None), (3, []), (4, [1.0, 2.0]), (5, [1.0, NAN, 2.0]), (6, [INF, 1.0, 2.0]), (7, [1.0, None, 2.0]), (8, [1e30, -1e30, 0.0]), (9, [-0.1, 0.1, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in vectors], "vec_id int, embedding array<double>, cluster string, distance int")
    kept = [(i, [max(-MOST, min(MOST, math.floor(64 * x))) for x in v]) for i, v in vectors if v and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda i: (hashlib.sha256(f"1:{'' if kept[i][0] is None else kept[i][0]}".encode()).hexdigest(), kept[i][1]))
    for k in (1, 2, 3, 16):
        own, distance, centres = brute_clusters([v for _, v in kept], order[:k], 2)
        want = sorted((str(i), c, d, centres[c]) for (i, _), c, d in zip(kept, own, distance))
        got = sorted((str(r.vec_id), r.cluster, r.distance, r.centroid) for r in centroid_clusters(df, k=k, dims=3, rounds=2).collect())
        assert got == want
    assert centroid_clusters(df.limit(0)).collect() == [] and centroid_clusters(df, dims=7).collect() == []
    with pytest.raises(ValueError):
        centroid_clusters(df, dims=0)


def test_empty_clusters_stay(spark):
    df = spark.createDataFrame([(i, [float(i % 2)]) for i in range(40)], "vec_id int, embedding array<float>")
    rows = centroid_clusters(df, k=16, dims=1, rounds=3).collect()  # of equal first centroids the smallest number takes all
    assert len({r.cluster for r in rows}) == 2 and {r.distance for r in rows} == {0} and {r.inertia for r in rows} == {0}


def brute_top(rows, every, k, factor=256):
    held = [(i, [max(-MOST, min(MOST, math.floor(factor * x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v) in enumerate(held):
        if i is not None and i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j) for b, (j, w) in enumerate(held) if b != a)
            out += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=str)


def top(df, **more):
    return sorted((tuple(r) for r in top_inner_products(df, **more).collect()), key=str)


def test_op13(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    got = sorted((tuple(r) for r in QUERIES["op13_topk_search"](spark, sf).collect()), key=str)
    assert got == brute_top(rows, 50, 5) and len(got) == 50


def test_top_edges(spark):
    same = [0.5, -0.25, 1.0]
    rows = [(0, same), (0, same), (3, same), (6, same), (7, same), (9, same), (None, same), (12, None), (15, []), (18, [1.0]), (21, [1.0, NAN, 0.0]), (24, [None, 1.0, 1.0]), (27, [-INF, 0.0, 0.0]), (30, [1e30, 1.0, 1.0]), (-3, [-1.0, -1.0, -1.0]), (1, [0.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id bigint, embedding array<float>, score double")
    want = brute_top([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 3, 4)
    for parts in (1, 2, 3, 9):
        assert top(df, every=3, k=4, parts=parts) == want
    assert top(df.limit(0)) == [] and top(df.where("vec_id = 1")) == [] and top(df.where("vec_id = 6"), every=3) == []
    assert top(df.where("vec_id in (1, 6)"), every=3) == [(6, 1, 1, 0)]


@pytest.mark.parametrize("seed", [1, 2])
def test_top_many_ties_and_passes(spark, seed, monkeypatch):
    """Few distinct components, so many equal scores and equal vectors; several passes of queries."""
    monkeypatch.setattr(threshold_search, "BLOCK", 3)
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.integers(-1, 2, 5)]) for i in rng.permutation(260)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(5)
    assert top(df, every=9, k=3, factor=2, heads=2, most_queries=6) == brute_top(rows, 9, 3, 2)


def test_cutoff_leaves_most_entries_out(spark):
    """The entries of the second phase are few, and products too large for floats are exact."""
    rng = np.random.default_rng(3)
    vectors = rng.integers(-40, 41, (2_000, 64))
    asked = Asked(vectors[:20], parts_of(64, 2))
    scores = vectors[:20] @ vectors.T
    asked.cutoffs = np.sort(scores, axis=1)[:, -6]
    reached = sum((asked.scores(slice(0, 20), vectors[:, low:high], p) * 2 >= asked.cutoffs[:, None]).sum() for p, (low, high) in enumerate(asked.bounds))
    assert reached < 0.1 * scores.size
    large = Asked(np.full((1, 4), MOST), parts_of(4, 1))
    assert large.scores(slice(0, 1), np.array([[MOST, 1, MOST, -1]]), 0)[0, 0] == 2 * MOST * MOST


def test_centroids_bound_their_closures():
    assert centroids.MOST_NUMBERS * 8 <= 8 << 20
