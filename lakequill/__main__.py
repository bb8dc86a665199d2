"""Commands: fetch-pages, chunk, index, eval, eval-all, chunk-compare. `python -m lakequill <command> --help`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lakequill import models, schemas
from lakequill.operators.chunking import SIZES, chunk_pages
from lakequill.operators.store import carry_over
from lakequill.plans import evaluate
from lakequill.plans.catalog import Corpus, catalog, provider_of, resolve
from lakequill.sources import fetch, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakequill", description=__doc__)
    p.add_argument("--data", default=".", help="the dataset folder")
    p.add_argument("--models", default="", help="JSON or YAML settings: embedders by provider and rerankers ('' and '_4b') as module:function")
    sub = p.add_subparsers(dest="command", required=True)
    f = sub.add_parser("fetch-pages")
    f.add_argument("sources")
    f.add_argument("--out", required=True)
    f.add_argument("--domain-delay", type=float, default=1.0)
    f.add_argument("--timeout", type=float, default=20.0)
    sub.add_parser("chunk").add_argument("--sizes", type=int, nargs="*", default=list(SIZES))
    i = sub.add_parser("index")
    i.add_argument("--method", default="qwen")
    i.add_argument("--sizes", type=int, nargs="*", default=list(SIZES))
    for name in ("eval", "eval-all", "chunk-compare"):
        e = sub.add_parser(name)
        e.add_argument("--methods", nargs="*", default=[])
        e.add_argument("--limit", type=int)
        e.add_argument("--category")
        e.add_argument("--show-ranks", action="store_true")
        e.add_argument("--checkpoint")
        e.add_argument("--output")
        e.add_argument("--sizes", type=int, nargs="*", default=[512])
    return p


def corpus_of(data: tables.Dataset, questions, methods: list[str], size: int, embedders: dict, rerankers: dict) -> Corpus:
    """The corpus of a size. Places of queries and points of pages are tables of the folder; without them no query is scoped."""
    chunks = data.load("chunks", size=size)
    providers = dict.fromkeys(filter(None, map(provider_of, methods)))
    vectors = {p: data.load("vectors", ["chunk_id", "vec"], provider=p, size=size) for p in providers}
    asked = questions.select(F.col("question_id").alias("query_id"), "text")
    places = data.optional("places", "query_id string, lat double, lon double, granularity string")
    points = data.optional("points", "page_id string, lat double, lon double")
    of_chunks = chunks.select(F.col("id").alias("chunk_id"), "page_id").join(points, "page_id").select("chunk_id", "lat", "lon")
    return Corpus(chunks.select("id", "text"), vectors, {p: models.embed(asked, "query_id", "text", embedders.get(p)) for p in providers}, rerankers, places, of_chunks)


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"lakequill {a.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    data = tables.Dataset(spark, a.data)
    settings = tables.config(a.models) if a.models else {}
    embedders, rerankers = models.named(settings, "embedders"), models.named(settings, "rerankers")
    if a.command == "fetch-pages":
        tables.append_fetched(fetch.with_text(fetch.fetch_all(tables.source_urls(spark, a.sources), timeout=a.timeout, delay=a.domain_delay)), a.out)
    elif a.command == "chunk":
        chunks = chunk_pages(data.load("pages", ["id", "title", "text"]), a.sizes)
        old = data.optional("chunks", schemas.CHUNK).withColumn("pos", F.col("n"))
        tables.replace_partitions(carry_over(chunks, old, ["role"]), data.path("chunks"), ["size"])  # other sizes stay
    elif a.command == "index":
        out = None
        for size in a.sizes:
            chunks = data.load("chunks", size=size)
            texts = chunks.select(F.col("id").alias("chunk_id"), F.concat_ws("\n", "title", "breadcrumb", "text").alias("text"))
            part = models.embed_missing(texts, data.vector_slots(a.method, size), "chunk_id", "text", embedder=embedders.get(a.method)).select(F.lit(a.method).alias("provider"), F.lit(size).cast("long").alias("size"), "chunk_id", "vec")
            out = part if out is None else out.unionByName(part)
        tables.replace_partitions(out, data.path("vectors"), ["provider", "size"])  # other providers and sizes stay
    else:
        names = list(catalog()) if a.command == "eval-all" else resolve(a.methods)
        results, providers = {}, list(dict.fromkeys(filter(None, map(provider_of, names))))
        for size in a.sizes:
            questions, qrels = evaluate.questions_with_evidence(data.load("questions"), data.load("chunks", size=size), a.limit, a.category)
            rankings, seconds = evaluate.run(questions, qrels, corpus_of(data, questions, names, size, embedders, rerankers), names, a.checkpoint, size)
            results[size] = (questions, qrels, rankings)
            if a.command != "chunk-compare":
                print(evaluate.report(questions, qrels, rankings, names, seconds, a.show_ranks, a.output, models.stand_ins(names, providers, embedders, rerankers)))
        if a.command == "chunk-compare":
            text = evaluate.compare_sizes(results, data.load("chunks"), names)
            print(text)
            if a.output:
                tables.write_text(text, a.output)


if __name__ == "__main__":
    main()
