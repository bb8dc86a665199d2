"""Label specifications, replies, place caches and hosted models."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lakequill.operators import labels, requests
from lakequill.operators.places import places_of
from lakequill.operators.replies import reply_items
from lakequill.operators.requests import Refused, Stopped, batches, embed_hosted, request
from lakequill.sources.versioned import Versioned


@pytest.mark.parametrize("spec", [labels.QUESTION, labels.TRIPLE, labels.PAGE])
def test_class_indices_and_back(spark, spec):
    right = {n: o[-1] for n, o in spec.items()}
    first = next(iter(spec))
    rows = [(0, right), (1, {n: o[0] for n, o in spec.items()}), (2, {}), (3, right | {first: "odd", "mood": "x"}), (4, None)]
    df = spark.createDataFrame(rows, "id int, given map<string,string>").withColumn("ix", labels.class_indices(spec, F.col("given")))
    got = {r.id: r for r in df.select("id", "ix", labels.labels_of(spec, F.col("ix")).alias("again"), labels.problems(spec, F.col("given")).alias("wrong")).collect()}
    assert got[0].ix == [len(o) - 1 for o in spec.values()] and got[0].again == right and got[0].wrong == []
    assert got[1].ix == [0] * len(spec) and got[2].ix == [None] * len(spec) and got[2].again == {} and len(got[2].wrong) == len(spec)
    assert got[3].wrong == [f"{first}: odd", "unknown mood"] and got[3].again == {n: v for n, v in right.items() if n != first}
    assert got[4].again == {}
    assert (len(labels.QUESTION), len(labels.TRIPLE), len(labels.PAGE)) == (13, 7, 8)


def test_replies(spark):
    given = [{"items": [{"a": 1, "q": ["x", "y"]}]}, [{"a": "2", "q": "z"}, {"item": 0, "labels": {"a": 3}}], {"items": []}, {"items": {"a": 1}}, {"other": []}, "text", 7, [1, None, {"a": {"b": 1}}]]
    rows = [(i, json.dumps(x)) for i, x in enumerate(given)] + [(20, None), (21, "no { json"), (22, "")]
    got = [tuple(r) for r in reply_items(spark.createDataFrame(rows, "id int, reply string"), "id", {"a": "int", "q": "string"}, nested="labels", joined=["q"]).collect()]
    want = [(0, 0, 1, "x y", None), (1, 0, 2, "z", None), (1, 1, 3, None, None), *((i, None, None, None, "no items") for i in (3, 4, 5, 6, 20, 21, 22)), (7, 0, None, None, "no object"), (7, 1, None, None, "no object"), (7, 2, None, None, None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_place_cache(spark, tmp_path):
    cache, asked = Versioned(spark, str(tmp_path / "places")), []

    def lookup(broken):
        def look(keys):
            asked.append(sorted(r.key for r in keys.collect()))
            found = keys.where(~F.col("key").isin(broken))
            hill = F.when(F.col("key").contains("hill"), 45.0)
            return found.select("key", hill.alias("lat"), hill.alias("lon"), hill.alias("decay_km"))

        return look

    queries = spark.createDataFrame([(1, "The  Hill"), (2, "the hill "), (3, "why?"), (4, "hill two"), (5, None)], "query_id int, text string")
    state = lambda broken: {r.query_id: (r.state, r.lat) for r in places_of(queries, cache, lookup(broken)).collect()}
    assert state(["hill two"]) == {1: ("place", 45.0), 2: ("place", 45.0), 3: ("none", None), 4: ("failed", None), 5: ("none", None)}
    assert state([]) == {1: ("place", 45.0), 2: ("place", 45.0), 3: ("none", None), 4: ("place", 45.0), 5: ("none", None)}
    assert state([])[4] == ("place", 45.0)
    assert asked == [["hill two", "the hill", "why?"], ["hill two"]]  # each key once, failures again, and then nobody


def test_batches():
    assert [len(b) for b in batches(["x"] * 600)] == [256, 256, 88] and list(batches([])) == []
    assert [len(b) for b in batches(["a" * 40, "b" * 40, "c" * 200, "d"], most_bytes=100)] == [2, 1, 1]


def test_request_halves_in_order_and_gives_up_single_texts():
    sizes = []

    def client(texts):
        sizes.append(len(texts))
        if len(texts) > 2 or "huge" in texts:
            raise Refused(413)
        return [[float(t)] for t in texts]

    assert request(client, [str(i) for i in range(8)]) == [[float(i)] for i in range(8)]
    assert sizes == [8, 4, 2, 2, 4, 2, 2]
    assert request(client, ["1", "huge", "3"]) == [[1.0], None, [3.0]]


def test_request_waits_tries_and_stops():
    slept, left = [], [Refused(429, wait=500.0), Refused(429, wait=5.0), Refused(503), OSError(), "few", None]

    def client(texts):
        e = left.pop(0)
        if isinstance(e, Exception):
            raise e
        return [] if e == "few" else [[1.0]] * len(texts)

    assert request(client, ["a", "b"], sleep=slept.append) == [[1.0], [1.0]]
    assert slept == [500.0, 60.0, 30.0, 60.0, 90.0]  # waits for the day's limit are no attempts

    def never(texts):
        raise Refused(502)

    slept.clear()
    assert request(never, ["a", "b"], sleep=slept.append) == [None, None] and len(slept) == requests.ATTEMPTS - 1

    def busy(texts):
        raise Refused(429)

    with pytest.raises(Stopped):
        request(busy, ["a"])


def client_of(folder, most):
    """Counts requests in files; answers `most` in all, then refuses without saying for how long."""

    def make():
        import os
        import uuid

        def client(texts):
            if len(os.listdir(folder)) >= most:
                raise Refused(429)
            if len(texts) > 3:
                raise Refused(400)
            open(f"{folder}/{uuid.uuid4().hex}", "w").close()
            return [[3.0, 4.0 * (not t.startswith("zero"))] for t in texts]

        return client

    return make


def test_hosted_embedding_stops_and_resumes(spark, tmp_path):
    folder = tmp_path / "requests"
    folder.mkdir()
    texts = spark.createDataFrame([(i, f"text {i}") for i in range(60)] + [(60, None), (None, "x"), (1, "text 1")], "id int, text string")
    done = Versioned(spark, str(tmp_path / "vectors"))
    options = {"waves": 4, "tasks": 2, "rpm": 1e9, "backoff": 0.0}
    first = embed_hosted(texts, "id", "text", done, client_of(str(folder), 9), **options)
    assert 0 < first["kept"] < 60 and first["failed"] > 0 and first["waves"] < 4  # no wave after the one that was stopped
    version = done.versions()[-1]
    second = embed_hosted(texts, "id", "text", done, client_of(str(folder), 10**6), **options)
    assert second["asked"] == second["kept"] == 60 - first["kept"] and done.versions()[-1] > version
    rows = done.read().collect()
    assert sorted(r.id for r in rows) == list(range(60)) and all(abs(r.vec[0] - 0.6) < 1e-6 for r in rows)
    assert embed_hosted(texts, "id", "text", done, client_of(str(folder), 0), **options)["asked"] == 0
