from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash

from lakequill.llm import simhash, suffix_dedup, toxicity
from lakequill.llm.components import components


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(3, 8))) for _ in range(n))


# Toxicity


@pytest.mark.parametrize("k", [1, 7, 60, 500])
@pytest.mark.parametrize("long_list", [2, 64, 10_000])
def test_block_max_index_is_exact(k, long_list):
    rng = np.random.default_rng(2)
    counts = [np.sort(rng.choice(200, rng.integers(0, 25), replace=False)) for _ in range(300)]
    ends = np.concatenate([[0], np.cumsum([len(c) for c in counts])])
    rows = toxicity.unit_rows(ends, np.concatenate(counts), rng.integers(1, 5, ends[-1]).astype(float), rng.random(200) + 0.1)
    dense = np.zeros((300, 200))
    dense[rows.of(), rows.terms] = rows.weights
    index = toxicity.BlockMaxIndex(rows, 200, block=8, long_list=long_list)
    for without in (None, index.place):
        got, kth = index.similarities(rows, k, without)
        want = dense @ dense[index.order].T
        if without is not None:
            want[np.arange(300), without] = -2
        best = np.sort(want, axis=1)[:, ::-1][:, min(k, 300 - (without is not None)) - 1]
        assert kth == pytest.approx(best)
        near = want >= best[:, None] - 1e-9
        assert got[:, :300][near] == pytest.approx(want[near]) and (got[:, :300][~near] < kth.repeat(300).reshape(300, 300)[~near]).all()


def test_scores_equal_brute_force(spark):
    """Votes of the nearest by whole TF-IDF vectors, written out in dense arrays."""
    docs, labels, known = corpus(spark, 150)
    got = {(r.doc_id, r.text_hash): r for r in toxicity.toxicity(docs, labels).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    words = [toxicity.word_counts(t) for _, t in texts]
    of = dict(zip([i for i, _ in texts], range(len(texts))))
    train = [(of[i], bad) for i, bad in known if zlib.crc32(str(i).encode()) % 5]
    voc = sorted({w for i, _ in train for w in words[i]})
    idf = np.array([np.log((1 + len(texts)) / (1 + sum(w in c for c in words))) + 1 for w in voc])
    idf = idf * np.array([brute_relevance([w in words[i] for i, _ in train], [y for _, y in train]) for w in voc])
    full = np.array([[(1 + np.log(c[w])) * x if c[w] else 0.0 for w, x in zip(voc, idf)] for c in words])
    full /= np.maximum(1e-300, np.sqrt((full * full).sum(axis=1)))[:, None]
    bad = np.array([float(y) for _, y in train])
    k = max(toxicity.LEAST_VOTERS, round(toxicity.VOTERS_SHARE * len(train)))

    def vote(sims):
        near = sims >= max(np.sort(sims)[::-1][k - 1], 0) - 1e-9
        return (sims[near] + 1e-9) @ bad[near] / (sims[near] + 1e-9).sum()

    left_out = []
    for n, (i, _) in enumerate(train):
        sims = full[i] @ full[[j for j, _ in train]].T
        sims[n] = -1
        left_out.append(vote(sims))
    slope, shift = toxicity.platt(np.array(left_out), bad, np.ones(len(bad)))
    seen = toxicity.toxicity(docs, labels).join(docs.select("text").withColumn("h", toxicity.F.xxhash64(toxicity.F.coalesce("text", toxicity.F.lit("")))), toxicity.F.col("h") == toxicity.F.col("text_hash")).select("text", "score").distinct().collect()
    want = {t: 1 / (1 + np.exp(-(slope * vote(full[i] @ full[[j for j, _ in train]].T) + shift))) for i, (_, t) in enumerate(texts)}
    assert {r.text or "": r.score for r in seen} == pytest.approx(want, abs=1e-7) and len(got) == len({(i, t) for i, t in texts})


def brute_relevance(there, bad):
    """1 + sqrt(G - 10.83) of the table of presence and label."""
    g, n = 0.0, len(bad)
    for h in (True, False):
        for b in (0, 1):
            seen = sum(x == h and y == b for x, y in zip(there, bad))
            expected = sum(x == h for x in there) * sum(y == b for y in bad) / n
            g += 2 * seen * np.log(seen / expected) if seen else 0.0
    return 1 + max(0.0, g - 10.83) ** 0.5


def test_marks_of_each_language_are_learnt(spark):
    """Long texts of two alphabets; toxic ones hold four of their alphabet's forty marks, so that no mark is frequent."""
    rng, rows, labels = random.Random(8), [], []
    marks = {a: ["".join(rng.choice(a) for _ in range(9)) for _ in range(40)] for a in ("abcdefg", "tuvwxyz")}
    for i in range(1_000):
        alphabet, bad = rng.choice(list(marks)), i % 5 == 0
        rows.append((i, words(rng, 120, alphabet) + " " + " ".join(rng.sample(marks[alphabet], 4) if bad else [])))
        labels.append((i, int(bad)))
    got = toxicity.toxicity(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(labels, "doc_id int, toxic int")).where("held_out").collect()
    bad = [r for r in got if r.doc_id % 5 == 0]
    assert sum(r.predicted for r in bad) >= 0.9 * len(bad) > 20 and sum(r.predicted for r in got if r.doc_id % 5) <= 0.02 * len(got)
    assert any(set(r.evidence_terms) & set(sum(marks.values(), [])) for r in bad)


def test_votes_that_point_the_wrong_way_reject_nothing():
    raw, label = np.array([0.0, 0.3, 0.3, 0.3]), np.array([1.0, 0.0, 0.0, 0.0])
    slope, shift = toxicity.platt(raw, label, np.ones(4))
    assert slope == 0 and shift < 0


def test_ids_that_are_text_and_repeat(spark):
    docs = spark.createDataFrame([(f"n{i % 50}", "mild words here" if i % 3 else "vile words here", 1) for i in range(100)], "doc_id string, text string, score int")
    labels = spark.createDataFrame([(f"n{i}", int(i % 3 == 0)) for i in range(50)], "doc_id string, toxic int")
    first, second = (sorted(map(str, toxicity.toxicity(docs.repartition(n), labels).collect())) for n in (2, 5))
    assert first == second and len(first) == 100
    assert toxicity.clean_rows(docs, labels).columns == docs.columns


def corpus(spark, n=700):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        text = words(rng, 60) + (" " + " ".join(rng.choice(["Nasty", "vile", "foulest"]) for _ in range(4)) if bad else "")
        rows.append((i, text, "de" if bad else "en", 1.0))
        if i % 10 != 9:
            labels.append((i, int(bad)))
    rows += [(None, None, None, None), (n, "", "en", 0.0), (n + 1, words(rng, 20_000), "en", 0.0), (0, rows[0][1], "x", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels + [(None, 1), (3, None), (3, 0)], "doc_id long, toxic int"), labels


def test_toxicity_learns_and_holds_out(spark):
    docs, labels, known = corpus(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    truth = dict(known)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert all(zlib.crc32(str(e).encode()) % 5 for e in r.evidence_examples)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held) > 0
    # held-out labels teach nothing
    flipped = labels.withColumn("toxic", toxicity.F.expr("case when crc32(string(doc_id)) % 5 = 0 then 1 - toxic else toxic end"))
    again = {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score) for r in got)


def test_toxicity_edges(spark):
    docs, labels, _ = corpus(spark, 60)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.25} and {r.predicted for r in none} == {0}
    clean = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert all(r.score < 0.5 for r in clean)


def test_clean_rows_keep_columns(spark):
    docs, labels, known = corpus(spark)
    kept = toxicity.clean_rows(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert None in ids and not {i for i, bad in known if bad} & set(ids)
    assert {i for i, bad in known if not bad} <= set(ids)


# SimHash


def reference_hash(text):
    ws = text.encode().lower().split()
    if not ws:
        return 0
    shingles = [b" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", ["", "  \t\n", "One", "A b c", "A b c d", "a a a a a a", "É é\x0bx\x0cy z", "w " * 70_000, "nb sp is one word"])
def test_simhash(text):
    assert simhash.simhash(text.encode()) == reference_hash(text)


def brute_components(fps, distance):
    up = simhash.Union()
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if a != b and (a ^ b).bit_count() <= distance:
                up.join(a, b)
    return {f: up.find(f) for f in fps}


def families(rng, n, flips):
    out = set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            out.add(base)
            for _ in range(rng.randrange(1, flips + 1)):
                base ^= 1 << rng.randrange(64)
    return sorted(out)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("crowded", [20_000, 3])
@pytest.mark.parametrize("parts", [None, [(tuple(range(0, 21)), 1), (tuple(range(21, 43)), 1), (tuple(range(43, 64)), 0)], [(tuple(range(32)), 2), (tuple(range(32, 64)), 1)]])
def test_links_equal_brute_force(spark, crowded, parts, monkeypatch):
    fps = families(random.Random(7), 60, 6)
    if parts:
        monkeypatch.setattr(simhash, "allocate", lambda *a: [simhash.Part(*p) for p in parts])
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, 4, crowded).collect()]
    assert all(0 < (a ^ b).bit_count() <= 4 for a, b in edges)
    up = simhash.Union()
    for a, b in edges:
        up.join(a, b)
    assert {f: up.find(f) for f in fps} == brute_components(fps, 4)


def test_dense_groups_are_walked_not_paired():
    rng = random.Random(1)
    fps = np.array(sorted({0} | {1 << a | 1 << b for a in range(40) for b in range(40)} | {rng.getrandbits(64) for _ in range(300)}), np.uint64)
    roles = np.zeros(len(fps), np.int8)
    edges = list(simhash.linked(fps, roles, 4))
    assert len(fps) ** 2 > 1 << 18 and len(edges) < len(fps)
    up = simhash.Union()
    for a, b in edges:
        up.join(a, b)
    assert {f: up.find(f) for f in fps.tolist()} == brute_components(fps.tolist(), 4)


@pytest.mark.parametrize("n", [0, 1, 10, 10**6, 10**10])
def test_allocation_covers_the_distance(n):
    both = np.full((64, 64), n // 4)
    np.fill_diagonal(both, n // 2)
    parts = simhash.allocate(n, both, 4)
    assert sum(p.threshold + 1 for p in parts) == 5
    bits = [b for p in parts for b in p.bits]
    assert len(bits) == len(set(bits))


def test_near_duplicates_edges(spark):
    rng = random.Random(9)
    base = words(rng, 400).split()
    near = base.copy()
    near[200] = "changed"
    rows = [(5, " ".join(base)), (3, " ".join(near)), (3, " ".join(near)), (9, words(rng, 300)), (4, None), (7, ""), (None, " ".join(base)), (None, words(rng, 50))]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    fps = {t or "": reference_hash(t or "") for _, t in rows}
    comp = brute_components(sorted(set(fps.values())), 4)
    want = {}
    for i, t in rows:
        want.setdefault(comp[fps[t or ""]], []).append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = [i for i in want[comp[r.fp % 2**64]] if i is not None]
        assert r.component_id == min(ids, default=None)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    heads = simhash.group_heads(df)
    assert heads.columns == df.columns and {r.doc_id for r in heads.collect()} >= {9, 4, None}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    n = 200
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)] + [(500, 501)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(150)]}[shape]
    rng.shuffle(edges)
    names = {i: rng.randrange(-(10**12), 10**12) for e in edges for i in e}
    up = simhash.Union()
    for a, b in edges:
        up.join(names[a], names[b])
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges] * 2, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {names[i]: up.find(names[i]) for e in edges if e[0] != e[1] for i in e}


# Suffix dedup


def brute_cut(texts, length):
    seen: dict = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def repeats(rng):
    passages = [words(rng, n) for n in (6, 12, 20, 40)]
    line = "A common line of the corpus, seen everywhere. "
    texts = []
    for _ in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.3 else line if rng.random() < 0.3 else words(rng, rng.randrange(1, 30)) for _ in range(rng.randrange(1, 6))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[0], "ab" * 300, "a" * 500, "é" * 120 + "x", "", "short", texts[1][:80] + "!" + texts[1][81:]]
    return texts


@pytest.mark.parametrize("crowded", [512, 1])
def test_repeated_passages_equal_brute_force(spark, crowded):
    texts = repeats(random.Random(11))
    common = words(random.Random(12), 20)
    texts += [f"{words(random.Random(k), 3)} {common} {words(random.Random(k + 100), 3 + k % 2)}" for k in range(40)]  # many surroundings of one passage
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1000, None, "x"), (None, texts[5], "x"), (7, texts[7], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = suffix_dedup.repeated_passages(df, length=60, anchor=16, crowded=crowded, pieces_of=(8, 4, 1)).collect()
    mine = sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    want = brute_cut([(t or "").encode() for _, t, _ in rows], 60)
    assert mine == sorted((str(i), *w) for (i, _, _), w in zip(rows, want))


def test_refine_in_one_group():
    data = b"0123456789abcdefghijklmnopqrstuvwxyz" * 3
    flags = suffix_dedup.refine([[(5, 10, data[:40]), (5, 10, data[:39] + b"!"), (5, 10, b"?" + data[1:40])]], 31)[0]
    assert [f.tolist() for f in flags] == [[True] * 10, [True] * 9 + [False], [False] + [True] * 9]


@pytest.mark.parametrize("slice_", [7, 1 << 16])
@pytest.mark.parametrize("seed", range(6))
def test_refine_equals_brute_force(seed, slice_):
    rng = random.Random(seed)
    groups = []
    for _ in range(rng.randrange(1, 5)):
        base = bytes(rng.choice(b"ab\0") for _ in range(120)) if seed % 2 else b"ab" * 60
        members = []
        for _ in range(rng.randrange(1, 9)):
            n, j0 = rng.randrange(1, 30), rng.randrange(30, 60)
            raw = bytearray(base[60 - j0 : 60 - j0 + n + 30])  # lanes meet at offset 60 of base
            for _ in range(rng.randrange(3)):
                raw[rng.randrange(len(raw))] ^= 1
            members.append((j0, n, bytes(raw)))
        groups.append(members)
    got = suffix_dedup.refine(groups, 31, slice_)
    for members, flags in zip(groups, got):
        strings = [[(j0 - s, raw[s : s + 31]) for s in range(n)] for j0, n, raw in members]
        for i, own in enumerate(strings):
            others = {x for k, other in enumerate(strings) if k != i for x in other}
            assert flags[i].tolist() == [x in others for x in own]


def test_no_passages(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, bytes(r.kept)) for r in suffix_dedup.repeated_passages(df).collect()) == [(0, b""), (1, b"a")]
    assert suffix_dedup.repeated_passages(df.limit(0)).count() == 0
