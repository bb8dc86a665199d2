"""Tables of versions: readers, lost writes, buckets, batches that run again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lakequill.operators.evaluation import lay_by_page, sampled_evidence, texts_of
from lakequill.sources import tables
from lakequill.sources.versioned import Conflict, Versioned, keep_latest, resume


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    return Versioned(spark, str(tmp_path / "t"))


def frame(spark, *found):
    return spark.createDataFrame(list(found), "k int, v string")


def test_a_write_that_is_lost_between_the_steps_changes_nothing(spark, table, monkeypatch):
    tables.replace(frame(spark, (1, "old")), table.path)
    with monkeypatch.context() as m:
        m.setattr(Versioned, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("the driver died")))
        for write in (lambda: tables.replace(frame(spark, (2, "new")), table.path), lambda: tables.replace_partitions(frame(spark, (2, "new")), table.path, ["k"])):
            with pytest.raises(RuntimeError):
                write()
            assert rows(tables.read_table(spark, table.path)) == [(1, "old")]
    tables.replace(tables.read_table(spark, table.path).unionByName(frame(spark, (2, "new"))), table.path)  # from itself
    assert rows(table.read()) == [(1, "old"), (2, "new")] and rows(table.read(1)) == [(1, "old")] and table.versions() == [1, 2]


def test_a_reader_keeps_its_version(spark, table):
    table.replace(frame(spark, (1, "a")))
    held = table.read()
    table.replace(frame(spark, (1, "b")))
    assert rows(held) == [(1, "a")] and rows(table.read()) == [(1, "b")]
    table.vacuum(keep=1)
    assert table.versions() == [2] and rows(table.read()) == [(1, "b")]
    assert len(list((__import__("pathlib").Path(table.path) / "data").iterdir())) == 1


def test_two_writers_of_one_version(spark, table):
    table.replace(frame(spark, (1, "a")))
    m = table.manifest()
    table.replace(frame(spark, (1, "b")))
    with pytest.raises(Conflict):
        table._commit({k: m[k] for k in m if k != "version"}, m["version"])
    assert rows(table.read()) == [(1, "b")]


def test_parts(spark, table):
    values = [(1, "a/b c", 0), (2, "x", 1), (None, "x", 2), (2, None, 3)]
    of = lambda found: spark.createDataFrame(found, "k int, v string, w int")
    table.replace(of(values), ["k", "v"])
    assert rows(table.read()) == sorted(values, key=str)
    assert rows(table.read(k=2, v="x")) == [(2, "x", 1)] and rows(table.read(v="a/b c")) == [(1, "a/b c", 0)] and rows(table.read(k=9)) == []
    assert len(table.read(k=2).inputFiles()) == 2
    before = {p: f for p, f in table.manifest()["parts"].items() if "k=2/v=x" not in p}
    tables.replace_partitions(of([(2, "x", 8), (2, "x", 9)]), table.path, ["k", "v"])
    assert rows(table.read(k=2, v="x")) == [(2, "x", 8), (2, "x", 9)] and before.items() <= table.manifest()["parts"].items()
    assert rows(table.read()) == sorted([v for v in values if v[2] != 1] + [(2, "x", 8), (2, "x", 9)], key=str)


def test_plain_parquet_becomes_a_table_of_versions(spark, tmp_path):
    path = str(tmp_path / "plain")
    frame(spark, (1, "a"), (2, "b")).write.partitionBy("k").parquet(path)
    assert rows(tables.read_table(spark, path).select("k", "v")) == [(1, "a"), (2, "b")]
    tables.replace_partitions(frame(spark, (2, "c")), path, ["k"])
    assert rows(tables.read_table(spark, path).select("k", "v")) == [(1, "a"), (2, "c")]


def test_merge_touches_its_buckets_only(spark, table):
    table.merge(frame(spark, *((i, "old") for i in range(40))), ["k"], buckets=8)
    before = table.manifest()["parts"]
    assert len(before) == 8
    table.merge(frame(spark, (3, "new"), (100, "new")), ["k"])
    after = table.manifest()["parts"]
    changed = [b for b in after if before[b] != after[b]]
    assert 1 <= len(changed) <= 2
    assert rows(table.read()) == sorted([(i, "new" if i == 3 else "old") for i in range(40)] + [(100, "new")], key=str)
    table.merge(frame(spark, (1, "x")).limit(0), ["k"])
    assert table.manifest()["parts"] == after
    with pytest.raises(ValueError):
        table.merge(frame(spark, (1, "x")), ["v"])


def test_a_batch_that_runs_again(spark, table):
    latest = keep_latest(["v"], ["k"])
    table.merge(frame(spark, (1, "a"), (1, "b"), (2, "a")), ["k"], latest, 4, ("stream", 0))
    version = table.merge(frame(spark, (1, "c")), ["k"], latest, 4, ("stream", 1))
    assert table.merge(frame(spark, (1, "z"), (5, "z")), ["k"], latest, 4, ("stream", 1)) == version
    assert rows(table.read()) == [(1, "c"), (2, "a")]
    table.merge(frame(spark, (2, "b")), ["k"], latest, 4, ("other", 0))
    assert rows(table.read()) == [(1, "c"), (2, "b")]


def test_resume(spark, table):
    seen = []

    def work(fresh):
        keys = sorted(r.k for r in fresh.select("k").distinct().collect())
        seen.append(keys)
        if 13 in keys and len(seen) < 5:
            raise RuntimeError("lost")
        return fresh.groupBy("k").agg(F.max("v").alias("v"))

    given = frame(spark, *((i, f"{i}-{j}") for i in range(30) for j in range(2)))
    for _ in range(6):
        try:
            done = resume(given, "k", table, work, groups=3, buckets=9)
            break
        except RuntimeError:
            continue
    assert rows(done) == sorted([(i, f"{i}-1") for i in range(30)], key=str)
    committed = [k for keys in seen if 13 not in keys for k in keys]
    assert len(committed) == len(set(committed))  # what a lost run had committed isn't worked on again
    n = len(seen)
    assert rows(resume(given, "k", table, work, groups=3, buckets=9)) == rows(done) and len(seen) == n


def test_candidate_pages_prune_folders(spark, tmp_path):
    texts = [(f"c{i}", f"p{i % 40}", f"Text number {i} stands here. And one more sentence follows it.") for i in range(200)]
    chunks = spark.createDataFrame(texts, "chunk_id string, page_id string, text string")
    path = str(tmp_path / "laid")
    lay_by_page(chunks, path, 16)
    laid = spark.read.parquet(path)
    plan = texts_of(laid, spark.createDataFrame([("p1",)], "page_id string"), 16)._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower() and "BroadcastHashJoin" in plan
    questions = spark.createDataFrame([(f"q{i}", f"p{i % 50}", [f"Text number {i} stands here."] if i % 4 else ["nowhere to be found at all"]) for i in range(60)], "question_id string, page_id string, quotes array<string>")
    sample, qrels = sampled_evidence(questions, laid, 10, 16)
    import hashlib

    order = sorted(range(60), key=lambda i: hashlib.sha1(f"q{i}".encode()).hexdigest())
    pages = {f"p{i % 50}" for i in order[:20]}
    fit = [i for i in order if i % 4 and f"p{i % 50}" in pages and i < 200 and i % 50 < 40 and i % 50 == i % 40][:10]
    assert {r.question_id for r in sample.collect()} == {f"q{i}" for i in fit}
    assert rows(qrels) == sorted((f"q{i}", f"c{i}") for i in fit)
