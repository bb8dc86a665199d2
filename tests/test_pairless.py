"""Joins that once compared pairs, against brute force over all pairs."""

from __future__ import annotations

import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lakequill.operators import qa
from lakequill.operators.similar import earlier_similar


@given(st.binary(max_size=20), st.binary(max_size=20))
def test_checksum_of_joined_parts(a, b):
    """What the trie rests on."""
    zeros = bytes(len(b))
    assert zlib.crc32(a + b) == zlib.crc32(a + zeros) ^ zlib.crc32(zeros) ^ zlib.crc32(b)


def brute_partners(rows):
    out = {}
    for i, item, lang, country, categories in rows:
        others = {j for j, other, la, co, ca in rows if None not in (i, item, lang, country, j, other) and other != item and (la, co) == (lang, country) and set(ca) & set(categories)}
        if others:
            out[i] = min(others, key=lambda j: (zlib.crc32((i + j).encode()), j))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_partners(spark, seed):
    """Ids of several lengths and alphabets, items with several pages, a hot group, lone pages, nulls."""
    rng = random.Random(seed)
    rows = [(f"{rng.choice(('de', 'en', 'ž'))}:{rng.choice(('', 'Q', 'Qé'))}{n}", rng.randrange(60) if n % 3 else None if n % 50 == 0 else n + 1_000, rng.choice("ab") if n % 31 else None, "c" if n % 5 else "lone" + str(n), rng.sample(["x", "y", "z"], rng.randrange(4))) for n in range(150)]
    df = spark.createDataFrame(rows, "id string, item int, lang string, country string, categories array<string>")
    assert {r.id: r.partner for r in qa.partners(df).collect()} == brute_partners(rows)
    assert {r.id: r.partner for r in qa.partners(df.drop("item")).collect()} == brute_partners([(r[0], r[0], *r[2:]) for r in rows])
    assert qa.partners(df.limit(0)).count() == 0


def test_partners_make_no_pairs(spark):
    df = spark.createDataFrame([(str(n), "a", "c", ["x"]) for n in range(300)], "id string, lang string, country string, categories array<string>")
    plan = qa.partners(df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("Window") <= 3  # the two smallest ids of a checksum


def brute_similar(rows, threshold):
    out = set()
    for g, at, words in rows:
        own = set(words or [])
        if g is not None and any(h == g and b < at and (o := set(other or [])) | own and len(own & o) >= threshold * len(own | o) for h, b, other in rows):
            out.add((g, at))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_earlier_similar(spark, threshold):
    rng = random.Random(7)
    bases = [[f"w{rng.randrange(25)}" for _ in range(rng.randrange(1, 15))] for _ in range(12)]
    rows = []
    for n in range(260):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(25)}"
        rows.append((rng.choice((1, 1, 1, 2, 3, None)), n, words if n % 40 else [] if n % 80 else None))
    rows += [(9, n, ["same", "words"]) for n in range(50)] + [(9, 50, ["same", "words", "and"])]
    df = spark.createDataFrame(rows, "g int, n int, words array<string>")
    got = [tuple(r) for r in earlier_similar(df, "g", "n", "words", threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_similar(rows, threshold)
    assert earlier_similar(df.limit(0), "g", "n", "words").count() == 0


def shuffled(df):
    """Bytes that df's stages write to shuffles."""
    spark = df.sparkSession
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    written = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages().apply(i) for i in range(stages().size()))}
    before = written()
    df.write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for key, n in written().items() if key not in before)


def test_similar_sets_do_not_travel_with_each_of_their_words(spark):
    rng = random.Random(3)
    rows = [(g, n, [f"w{rng.randrange(900)}" for _ in range(400)]) for g, n in [(g, n) for g in range(100) for n in range(2)]]
    df = spark.createDataFrame(rows, "g int, n int, words array<string>").repartition(4).persist()
    df.count()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables would be sent whole
    try:
        assert shuffled(earlier_similar(df, "g", "n", "words")) < 8 * sum(len(w) for _, _, ws in rows for w in ws)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        df.unpersist()


def test_rule_flags_keep_a_pages_words_out_of_shuffles(spark):
    from lakequill.operators import qa

    rng = random.Random(5)
    body = " ".join(f"{rng.randrange(10**9):x}words" for _ in range(3000))
    items = [(1, n, f"question {n} of words", "query", ["fact"]) for n in range(300)]
    i = spark.createDataFrame(items, "page_id int, n int, question string, query string, facts array<string>").repartition(4)
    flags = qa.rule_flags(i, spark.createDataFrame([(1, "A title", body)], "page_id int, title string, text string").repartition(2))
    assert shuffled(flags) < 20 * len(body)
