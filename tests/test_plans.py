from __future__ import annotations

import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lakequill import models, schemas
from lakequill.__main__ import main
from lakequill.operators import ingest
from lakequill.plans import evaluate, registry, release, reports
from lakequill.plans.catalog import Corpus
from lakequill.sources import fetch, gazetteer, tables
from lakequill.sources.versioned import Versioned
from lakequill.streaming import log

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1


def test_every_sql_belongs_to_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES) <= set(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_equal_their_sql(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    if name not in registry.ORACLE:
        assert got.count() >= 0
        return
    want = duck.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())


def test_imports_without_the_corpus_package(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lakequill", tmp_path / "lakequill", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE))], out.stderr


def test_tables(spark, tmp_path):
    data = tables.Dataset(spark, str(tmp_path))
    rows = [("p:256:0", "p", 256, 0, "T", None, "a", 1, None), ("p:512:0", "p", 512, 0, "T", None, "b", 1, "x")]
    data.write("chunks", spark.createDataFrame(rows, schemas.CHUNK), ["size"])
    data.write("chunks", spark.createDataFrame(rows, schemas.CHUNK), ["size"])
    assert [r.id for r in data.load("chunks", ["id"], size=512).collect()] == ["p:512:0"]
    assert data.read("chunks", schemas.chunk_rules()).count() == 2
    plan = data.load("chunks", ["id"], size=512, title="T")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(title), EqualTo(title,T)]" in plan and "size" in plan.split("PartitionFilters: [")[1]
    with pytest.raises(Exception, match="row breaks rule: size"):
        schemas.checked(spark.createDataFrame([("a", 3)], "id string, size long"), {"size": F.col("size").isin(256)}).collect()
    ids = spark.createDataFrame([("p:256:0",), ("p:256:0",), ("z",)], "id string")
    assert data.rows_of("chunks", ids).count() == 1
    assert {r.chunk_id: r.vec for r in data.vector_slots("qwen", 256).collect()} == {"p:256:0": None}
    data.write("vectors", spark.createDataFrame([("qwen", 256, "p:256:0", [1.0])], schemas.VECTOR), ["provider", "size"])
    assert data.embeddings("qwen", 256).count() == 1
    with pytest.raises(ValueError, match="has 0 vectors"):
        data.embeddings("qwen", 512)
    assert schemas.duplicate_keys(data.load("chunks"), "id").count() == 0
    assert not list(tmp_path.glob("*.tmp")) and not list(tmp_path.glob("*.old"))
    assert len(tables.checksums(spark, str(tmp_path)).collect()) >= 3


def test_source_urls(spark, tmp_path):
    lines, array, empty = (tmp_path / n for n in ("a.jsonl", "b.json", "c.json"))
    lines.write_text('{"source": " s ", "url": " http://a "}\n{"source": "", "url": "x"}\n{"url": "y"}\n')
    array.write_text('\n [{"source": "s",\n "url": "http://a"}]')
    empty.write_text("")
    assert [[tuple(r) for r in tables.source_urls(spark, str(p)).collect()] for p in (lines, array, empty)] == [[("s", "http://a")], [("s", "http://a")], []]


def test_log_and_layers(spark, tmp_path):
    path = str(tmp_path / "log")
    row = lambda url, text, day: (None, "s", url, None, 200, "text/html", None, None, None, None, None, datetime(2024, 1, day), text)
    tables.append_fetched(spark.createDataFrame([row("u", None, 1)], schemas.FETCHED), path)
    tables.append_fetched(spark.createDataFrame([row("u", "new", 2), row("v", "x", 1)], schemas.FETCHED), path)
    rows = tables.fetched_log(spark, path)
    assert sorted(r.text for r in rows.collect()) == ["", "new", "x"]
    assert tables.layer(spark, str(tmp_path / "none"), "array<string>").count() == 0
    out = log.latest_to(log.read_log(spark, path, schemas.FETCHED, files_a_trigger=1), ["url"], ["fetched_at"], str(tmp_path / "latest"), str(tmp_path / "state"))
    out.awaitTermination()
    assert {r.url: r.text for r in Versioned(spark, str(tmp_path / "latest")).read().collect()} == {"u": "new", "v": "x"}


def test_streamed_counts(spark, tmp_path):
    rows = spark.createDataFrame([("a", datetime(2024, 1, 1, 0, 1)), ("a", datetime(2024, 1, 1, 0, 2)), ("b", datetime(2024, 1, 1, 0, 7))], "k string, at timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    counted = log.counts_by_window(log.read_log(spark, str(tmp_path / "in"), "k string, at timestamp", "parquet"), "at", "k")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.sql("select * from counted").collect()) == [("a", 2), ("b", 1)]


def test_fetching():
    seen = []

    def get(url, timeout):
        seen.append(url)
        if url.startswith("https://bad"):
            raise OSError("certificate verify failed")
        return fetch.Response(url, {"busy": 429, "robot": 403}.get(url.split("/")[2], 200) if seen.count(url) < 2 else 200, "text/html", "see our Robot Policy")

    waits = []
    assert fetch.fetch("http://busy/x", get, wait=waits.append).status == 200 and len(waits) == 1
    assert fetch.fetch("https://bad/x", get).url == "http://bad/x"
    assert fetch.fetch("http://robot/x", get, lambda u, t: fetch.Response(u, 200, "text/html", "ok")).body == "ok"
    assert fetch.first_document([{"label": "A", "url": "a"}, {"label": "B", "url": "b"}], lambda u: ("", None) if u == "a" else ("text", None)) == ("# B\n\ntext", "b", None)
    assert fetch.first_document([{"label": "A", "url": "a"}, {"label": "B", "url": "b"}], lambda u: ("", "broken")) == ("", "a", "broken")
    assert fetch.extract_with("u", "", render=lambda u: "<main><p>shown</p></main>")[2] == "shown"


def test_fetch_table(spark):
    def get(url, timeout):
        if "bad" in url:
            raise OSError("down")
        return fetch.Response(url, 200, "text/html", "<p>hi</p>")

    rows = fetch.fetch_all(spark.createDataFrame([("s", "http://a/1"), ("s", "http://bad/1")], schemas.SOURCE_URL), get, delay=0).collect()
    assert {r.url: (r.status, r.error) for r in rows} == {"http://a/1": (200, None), "http://bad/1": (None, "OSError: down")}


def test_gazetteer_requests():
    assert [len(b) for b in gazetteer.in_batches([str(i) for i in range(120)])] == [50, 50, 20]
    answers = iter([(429, {}), (200, {"ok": 1})])
    assert gazetteer.patient(lambda: next(answers), wait=lambda s: None) == {"ok": 1}
    with pytest.raises(RuntimeError, match="404"):
        gazetteer.patient(lambda: (404, {}))


def test_throttle_equals_the_recurrence(spark):
    arrivals = [("a", 0.0, 1), ("a", 0.5, 2), ("a", 5.0, 3), ("a", 5.1, 4), ("b", 0.2, 5)]
    df = spark.createDataFrame(arrivals, "d string, at double, id int")
    got = {r.id: r.start_at for r in ingest.throttled(df, "d", "at", 1.0, "id").collect()}
    last: dict = {}
    for d, at, i in arrivals:
        last[d] = max(at, last.get(d, -1e9) + 1.0)
        assert got[i] == pytest.approx(last[d])
    assert [r.start_at for r in ingest.throttled(df, "d", "at", 0, "id").orderBy("id").collect()] == [a[1] for a in arrivals]


def test_models(spark):
    replies = iter(["no json", '{"a": 1}', '{"a": 1, "b": 2}'])
    asked = []
    assert models.structured(lambda p: (asked.append(p), next(replies))[1], "Q", ["a", "b"]) == {"a": 1, "b": 2}
    assert "missing b" in asked[2]
    with pytest.raises(RuntimeError, match="no reply"):
        models.structured(lambda p: None, "Q", ["a"])
    with pytest.raises(KeyError):
        models.prompt("Hello $name")
    with pytest.raises(ValueError, match="512"):
        models.supported(512, 4096)
    texts = spark.createDataFrame([("a", "castle"), ("b", "castle"), ("c", None)], "id string, text string")
    rows = {r.id: r.vec for r in models.embed(texts, "id", "text").collect()}
    assert rows["a"] == rows["b"] and sum(x * x for x in rows["a"]) == pytest.approx(1)
    known = spark.createDataFrame([("a", [9.0]), ("b", None)], "id string, vec array<float>")
    assert {r.id: len(r.vec) for r in models.embed_missing(texts, known, "id", "text").collect()} == {"a": 1, "b": 64, "c": 64}
    with pytest.raises(Exception, match="more than 0|more than 1 tokens"):
        models.embed(texts, "id", "text", most_tokens=1, count=len).collect()
    out = models.structured_all(texts, "id", "text", lambda: lambda p: '{"x": 1}' if p == "castle" else None, ["x"]).collect()
    assert {r.id: (r.reply, r.error is None) for r in out} == {"a": ('{"x": 1}', True), "b": ('{"x": 1}', True), "c": (None, False)}


def test_reports():
    assert reports.plain_table(["a", "b"], [["x", 0.5]]).splitlines()[2] == "| x | 0.500 |"
    table = reports.bold_best_table(["m", "v"], [["a", 0.5], ["b", 0.5], ["c", 0.1]])
    assert table.count("**0.500**") == 2 and "**a**" not in table


QUESTIONS = [("p1:q:0", "p1", "easy", "castle history", ["Canonical castle"], True, "test"), ("p2:q:0", "p2", "hard", "forest trail", ["Canonical forest"], True, "test"), ("p2:q:1", "p2", "hard", "x", ["Canonical forest"], None, "test"), ("p1:q:1", "p1", "easy", "x", ["Canonical castle"], True, "dev")]


def test_evaluation_run(spark, tmp_path):
    chunks = spark.createDataFrame([("p1:512:0", "p1", 512, "Canonical castle chunk."), ("p2:512:0", "p2", 512, "Canonical forest chunk.")], "id string, page_id string, size long, text string")
    questions, qrels = evaluate.questions_with_evidence(spark.createDataFrame(QUESTIONS, schemas.QUESTION), chunks)
    assert questions.count() == 2 and qrels.count() == 2
    corpus = Corpus(chunks.select("id", "text"))
    rankings, seconds = evaluate.run(questions, qrels, corpus, ["sparse"], str(tmp_path / "check"))
    again, saved = evaluate.run(questions, qrels, corpus, ["sparse"], str(tmp_path / "check"))
    assert list(seconds) == ["sparse"] and saved == {} and again.count() == rankings.count() == 2
    text = evaluate.report(questions, qrels, rankings, ["sparse"], seconds, True, str(tmp_path / "out"))
    assert "**1.000**" in text and "hit@5 by type" in text and (tmp_path / "out/eval_latest.txt").read_text() == text
    assert "chars_10" in evaluate.compare_sizes({512: (questions, qrels, rankings)}, chunks, ["sparse"])


def test_commands(spark, tmp_path, capsys):
    data = tables.Dataset(spark, str(tmp_path))
    data.write("pages", spark.createDataFrame([("p1", "Castle", "# Castle\n\nCanonical castle text stands here. " + "More words follow. " * 30), ("p2", "Forest", "# Forest\n\nCanonical forest text stands here. " + "Trees grow. " * 30)], "id string, title string, text string"))
    data.write("questions", spark.createDataFrame(QUESTIONS, schemas.QUESTION))
    for _ in range(2):
        main(["--data", str(tmp_path), "chunk", "--sizes", "512"])
    main(["--data", str(tmp_path), "index", "--method", "qwen", "--sizes", "512"])
    main(["--data", str(tmp_path), "eval", "--methods", "sparse", "qwen_hybrid", "--show-ranks"])
    main(["--data", str(tmp_path), "chunk-compare", "--methods", "sparse", "--output", str(tmp_path / "sizes.md")])
    out = capsys.readouterr().out
    assert "qwen_hybrid" in out and (tmp_path / "sizes.md").exists()
    # Another provider and another size leave what is there; then geography and everything at once have what they need.
    main(["--data", str(tmp_path), "chunk", "--sizes", "256"])
    for provider in schemas.PROVIDERS[1:]:
        main(["--data", str(tmp_path), "index", "--method", provider, "--sizes", "512"])
    kept = {(r.provider, r.size) for r in tables.read_table(spark, str(tmp_path / "vectors.parquet")).select("provider", "size").distinct().collect()}
    assert kept == {(p, 512) for p in schemas.PROVIDERS}
    assert {r.size for r in tables.read_table(spark, str(tmp_path / "chunks.parquet")).collect()} == {256, 512}
    main(["--data", str(tmp_path), "eval", "--methods", "qwen_hybrid_rerank_geo"])  # no places: no query is scoped
    first = spark.createDataFrame(QUESTIONS, schemas.QUESTION).first().question_id
    data.write("places", spark.createDataFrame([(first, 45.0, 15.0, "site")], "query_id string, lat double, lon double, granularity string"))
    data.write("points", spark.createDataFrame([("p1", 45.0, 15.0), ("p2", 50.0, 15.0)], "page_id string, lat double, lon double"))
    main(["--data", str(tmp_path), "eval", "--methods", "qwen_hybrid_rerank_geo"])
    assert capsys.readouterr().out.count("qwen_hybrid_rerank_geo") >= 2


def test_eval_all_asks_for_every_provider(spark, tmp_path, monkeypatch):
    data = tables.Dataset(spark, str(tmp_path))
    data.write("pages", spark.createDataFrame([("p1", "Castle", "# Castle\n\nCanonical castle text stands here. " + "More words follow. " * 30)], "id string, title string, text string"))
    data.write("questions", spark.createDataFrame(QUESTIONS, schemas.QUESTION))
    main(["--data", str(tmp_path), "chunk", "--sizes", "512"])
    main(["--data", str(tmp_path), "index", "--method", "qwen", "--sizes", "512"])
    with pytest.raises(RuntimeError, match="nemotron8b"):
        main(["--data", str(tmp_path), "eval-all"])
    asked = []
    monkeypatch.setattr(evaluate, "run", lambda questions, qrels, corpus, names, *rest: (asked.append((names, corpus)) or None, {}))
    monkeypatch.setattr(evaluate, "report", lambda *a: "")
    main(["--data", str(tmp_path), "eval-all"])
    names, corpus = asked[0]
    assert len(names) == 38 and set(corpus.vectors) == set(schemas.PROVIDERS) and corpus.places.count() == 0


def test_fetched_pages_are_extracted(spark):
    schema = "source string, url string, final_url string, status int, content_type string, html string, error string, fetched_at timestamp"
    page = "<html lang='de'><head><title>T</title></head><body><nav><a href='/'>Home</a></nav><article><p>A text that stands in the article.</p></article></body></html>"
    rows = [("s", "https://a/1", "https://a/1", 200, "text/html", page, None, None), ("s", "https://a/2", "https://a/2", 404, "text/html", page, None, None), ("s", "https://a/3", None, None, None, None, "Timeout: x", None), ("s", "https://a/4", "https://a/4", 200, "text/html", "<i id=cf-chl-x>", None, None), ("s", "https://a/5", "https://a/5", 200, "text/html", None, None, None)]
    got = {r.url[-1]: r for r in fetch.with_text(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"].text == "A text that stands in the article." and got["1"].language == "de" and got["1"].title == "T" and got["1"].char_count == len(got["1"].text) and got["1"].error is None
    assert [got[k].error for k in "234"] == ["http 404", "Timeout: x", "bot check"] and {got[k].text for k in "2345"} == {""}
    assert fetch.with_text(spark.createDataFrame([], schema)).count() == 0


def test_checksums_read_files_in_blocks(spark, tmp_path, monkeypatch):
    import hashlib

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "large file.bin").write_bytes(bytes(range(256)) * 20_000)
    (tmp_path / "SHA256SUMS").write_text("x")
    got = tables.checksums(spark, str(tmp_path)).collect()
    assert [(r.name, r.sha256) for r in got] == [("large file.bin", hashlib.sha256(bytes(range(256)) * 20_000).hexdigest())]


def test_release(spark):
    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    questions = make("key string, page_id string, j int, question string, verdict string", ("q|a|0", "a", 0, "Same thing?", "keep"), ("q|b|0", "b", 0, "same THING", "keep"), ("q|b|1", "b", 1, "Other?", "keep"), ("q|b|2", "b", 2, "Near?", "drop"))
    marked = release.ambiguous(questions, make("key string, similarity double", ("q|b|1", 0.97), ("q|b|2", 0.99)))
    assert {r.key: r.ambiguous_across_pages for r in marked.collect()} == {"q|a|0": True, "q|b|0": True, "q|b|1": False, "q|b|2": True}
    challenge = make("page_id string, j int, question string, challenge_ok boolean, likely_ambiguous boolean", ("a", 5, "Hard?", True, False), ("a", 6, "Odd?", True, True))
    kept = release.kept_items(marked, challenge)
    assert sorted((r.kind, r.question) for r in kept.collect()) == [("challenge", "Hard?"), ("corpus", "Other?")]
    pages = make("page_id string, title string, wikidata_id string, language string", ("a", "Hard (x)", "Q1", "sv"), ("b", "Lake", "Q2", "de"))
    answers = make("page_id string, kind string, src_j int, question string, answer string", ("a", "challenge", 5, "Hard?", "yes"), ("b", "corpus", 1, "Older?", "no"))
    judged = make("question_id string, answer_ok boolean", ("a:challenge:0", True))
    rows = {r.question_id: r for r in release.rag_rows(kept, pages, answers, judged, make("question_id string, bm25_rank long", ("b:corpus:0", 3)), make("question_id string, n_relevant long", ("a:challenge:0", 1)), ["sv", "de", "fr"]).collect()}
    assert rows["a:challenge:0"].answer == "yes" and rows["a:challenge:0"].title_in_question and rows["a:challenge:0"].answer_ok and rows["a:challenge:0"].qrels_judged
    assert rows["b:corpus:0"].answer is None and rows["b:corpus:0"].bm25_rank == 3 and rows["b:corpus:0"].x_language != "de"
    items = make("page_id string, items array<string>, labels array<struct<a: boolean>>", ("a", ["x", "y"], [(True,), (False,)]), ("b", ["z"], []))
    assert [(r.page_id, r.item) for r in release.all_criteria(items, "labels", ["a"]).collect()] == [("a", "x")]
    assert {r.key for r in release.keyed_questions(("q", questions)).collect()} == {"q|a|0", "q|b|0", "q|b|1", "q|b|2"}
    bad = release.batch_problems(make("page_id string, j int, facts array<string>", ("a", 0, ["f"]), ("a", 1, ["f"]), ("a", 2, [])), make("page_id string, j int", ("a", 0), ("a", 2), ("a", 9)))
    assert {(r.j, r.problem) for r in bad.collect()} == {(1, "missing"), (9, "unexpected"), (2, "facts")}
    near = make("anchor_id long, place_id long, km double", (1, 2, 1.0), (1, 3, 2.0), (2, 1, 1.0))
    specs = release.meta_specs(make("id long, country string, categories array<string>", (1, "SE", ["lake"]), (2, "SE", ["lake"]), (3, "SE", ["hill"])), near, ["sv", "en"]).collect()
    assert {r.key for r in specs} == {"list|lake|SE", "geo|1"} and all(r.language in ("sv", "en") for r in specs)
    jobs = release.qrel_jobs(challenge, make("lang string, page_id string, question string", ("sv", "a", "C?")), make("page_id string, question string, ok boolean", ("z", "U?", True), ("z", "V?", False)))
    assert {(r.question, r.tier) for r in jobs.collect()} == {("Hard?", 0), ("Odd?", 0), ("C?", 0), ("U?", 1)}
    parts = release.prompt_items(make("page_id string, j int, question string", ("a", 1, "B?"), ("a", 0, "A?")), make("page_id string, title string, text string, distinctive array<string>", ("a", "Old Town", "text", ["town", "wall"]))).first()
    assert parts["items"].splitlines()[0] == '{"j":0,"question":"A?"}' and parts["forbidden"] == ["town", "wall", "old"]
    final = make("c double, ok boolean, fix double", (1.0, True, 2.0), (1.0, None, 2.0)).select(release.final_answer(F.col("c"), F.col("ok"), F.col("fix")).alias("x"))
    assert [r.x for r in final.collect()] == [1.0, 2.0]


def test_question_ranks_and_language_flags(spark):
    make = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    pages = make("page_id string, title string, text string", ("a", "Castle", "stone walls " * 200), ("b", "Forest", "old trees"))
    lead = {r.page_id: r.text for r in release.page_lead(pages).collect()}
    assert lead["b"] == "Forest\nold trees" and len(lead["a"]) == len("Castle\n") + 1_000
    questions = make("query_id long, text string, own_id string", (1, "trees", "b"), (2, "nothing", "a"))
    docs = pages.select(F.col("page_id").alias("id"), "text")
    vec = make("chunk_id string, vec array<float>", ("a", [1.0, 0.0]), ("b", [0.0, 1.0]))
    got = release.question_ranks(questions, docs, make("query_id long, vec array<float>", (1, [1.0, 0.0])), vec).orderBy("query_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, -1.0), (2, 101, None, None)]
    flags = make("page_id string, n long, flags array<string>", ("a", 0, ["dup"]), ("a", 1, []))
    items = make("page_id string, n long, own boolean, en boolean", ("a", 0, False, None), ("a", 1, True, False))
    assert {r.n: r.flags for r in release.with_language_flags(flags, items, F.col("own"), F.col("en")).collect()} == {0: ["dup", "q_lang"], 1: ["en_lang"]}


def _as_sql(spark, name, folder):
    import duckdb

    con = duckdb.connect()
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    found = con.execute(registry.ORACLE[name])
    got = registry.QUERIES[name](spark, str(folder)).select(*(c[0] for c in found.description))
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, found.fetchall()))


def test_label_consistency_repeats_by_words(spark, tmp_path):
    import pandas as pd

    texts = ["Hello, world", "hello world!", "Hello  world", "other", "ΟΔΟΣ x", "οδοσ x"]
    pd.DataFrame({"doc_id": range(6), "text": texts, "lang": "en"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"doc_id": range(6), "quality": 1, "toxic": 0}).to_parquet(tmp_path / "labels.parquet")
    got, expected = _as_sql(spark, "label_consistency", tmp_path)
    assert got == expected and sum("repeated" in row for row in got) == 3


def test_titles_in_questions_short_titles(spark, tmp_path):
    import pandas as pd

    titles = ["what", "o", "Other", "İs ΣΑΣ", "X (town)", ""]
    pd.DataFrame({"page_id": range(12), "url": "u", "html": [f"<title>{t}</title>" for t in titles for _ in (0, 1)]}).to_parquet(tmp_path / "pages.parquet")
    got, expected = _as_sql(spark, "titles_in_questions", tmp_path)
    assert got == expected
