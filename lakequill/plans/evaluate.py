"""An evaluation run: relevance from evidence, a ranking for each method with a checkpoint, metrics, cost, report."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import evaluation
from lakequill.operators.store import materialized
from lakequill.plans.catalog import Corpus, ensure_ready, resolve, retrieve
from lakequill.plans.reports import bold_best_table, plain_table
from lakequill.sources.tables import write_text

RESULT_LIMIT = 10
#: Questions of a run unless said otherwise; folders of lay_by_page.
DEFAULT_QUESTIONS, BUCKETS = 2_000, 64


def signature(questions: DataFrame) -> str:
    """Of the list of question ids: a checkpoint counts only for the same questions."""
    ids = [r[0] for r in questions.select("question_id").orderBy("question_id").toLocalIterator()]  # a sample of bounded size
    return hashlib.sha256("\n".join(map(str, ids)).encode()).hexdigest()[:16]


def questions_with_evidence(questions: DataFrame, chunks: DataFrame, limit: int | None = None, qtype: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(questions, qrels): the stable sample of those test questions that a chunk of their page answers. chunks as they are, or a table of lay_by_page, of which only the sample's pages are read."""
    asked = evaluation.eval_questions(questions, qtype)
    held = chunks.select(F.col("id").alias("chunk_id"), "page_id", "text").withColumn("page_bucket", evaluation.page_bucket(F.col("page_id"), BUCKETS)) if "page_bucket" not in chunks.columns else chunks.withColumnRenamed("id", "chunk_id")
    return evaluation.sampled_evidence(asked, held, limit or DEFAULT_QUESTIONS, BUCKETS)


def run(questions: DataFrame, qrels: DataFrame, corpus: Corpus, methods: Sequence[str] | None = None, checkpoint: str | None = None, size: int | str = "all") -> tuple[DataFrame, dict[str, float]]:
    """(rankings of all methods, seconds of each). A method whose ranking lies in the checkpoint for these questions isn't run again."""
    spark = questions.sparkSession
    names = resolve(list(methods or []))
    ensure_ready(names, corpus)
    asked = questions.select(F.col("question_id").alias("query_id"), "text")
    mark = signature(questions)
    out, seconds = None, {}
    for name in names:
        path = f"{checkpoint}/questions={mark}/size={size}/method={name}" if checkpoint else None
        began = time.monotonic()
        ranked = _saved(spark, path) if path else None
        if ranked is None:
            ranked = retrieve(name, asked, corpus, RESULT_LIMIT)
            if path:
                ranked.write.mode("overwrite").parquet(path)
                ranked = spark.read.parquet(path)
            else:
                ranked = materialized(ranked, f"ranking-{name}")
            seconds[name] = time.monotonic() - began
        out = ranked if out is None else out.unionByName(ranked)
    return out, seconds


def _saved(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def scores(questions: DataFrame, qrels: DataFrame, rankings: DataFrame, methods: Sequence[str]) -> list[dict]:
    out = []
    for m in methods:
        row = evaluation.metrics(qrels, rankings.where(F.col("method") == m)).first()
        out.append({"method": m} | row.asDict())
    return out


def report(questions: DataFrame, qrels: DataFrame, rankings: DataFrame, methods: Sequence[str], seconds: dict[str, float], ranks: bool = False, folder: str | None = None, notes: Sequence[str] = ()) -> str:
    """Metrics, hit@5 by question type and cost as Markdown; with ranks each question's first relevant rank; notes, such as which models are stand-ins, at the end. A folder gets the latest and a dated copy."""
    n = questions.count()
    rows = scores(questions, qrels, rankings, methods)
    header = list(rows[0]) if rows else ["method"]
    parts = ["## Methods", bold_best_table(header, [[r[h] for h in header] for r in rows])]
    types = questions.select("question_id", "qtype")
    by_type = {m: {r["qtype"]: r["hit_5"] for r in evaluation.metrics(qrels, rankings.where(F.col("method") == m), by=types, group="qtype").collect()} for m in methods}
    kinds = sorted({k for d in by_type.values() for k in d})
    parts += ["## hit@5 by type", bold_best_table(["method", *kinds], [[m, *(by_type[m].get(k, 0.0) for k in kinds)] for m in methods])]
    cost = [[m, s, 1000 * s / max(n, 1), n / max(s, 1e-9), n] for m, s in seconds.items()]
    parts += ["## Cost", plain_table(["method", "seconds", "ms_per_query", "queries_per_second", "queries"], cost)]
    if ranks:
        table = evaluation.rank_table(qrels, rankings, questions, list(methods))
        parts += ["## Ranks", plain_table(table.columns, [list(r) for r in table.orderBy("question_id").collect()])]
    if notes:
        parts += ["## Notes", "\n".join(f"- {n}" for n in notes)]
    text = "\n\n".join(parts) + "\n"
    if folder:
        write_text(text, f"{folder}/eval_latest.txt", f"{folder}/eval_{datetime.now(UTC):%Y%m%d_%H%M%S}.txt")
    return text


def compare_sizes(results: dict[int, tuple[DataFrame, DataFrame, DataFrame]], chunks: DataFrame, methods: Sequence[str]) -> str:
    """results: size to (questions, qrels, rankings). Chunks of each size, and each method's metrics and characters read by size."""
    profile = {r["size"]: r for r in evaluation.size_profile(chunks).collect()}
    rows = [[s, profile[s]["chunks"], profile[s]["mean_chars"]] for s in results if s in profile]
    parts = ["## Sizes", plain_table(["size", "chunks", "mean_chars"], rows)]
    for m in methods:
        lines = []
        for s, (_, qrels, rankings) in results.items():
            own = rankings.where(F.col("method") == m)
            r = evaluation.metrics(qrels, own).first()
            chars = evaluation.chars_at_k(own, chunks.where(F.col("size") == s), RESULT_LIMIT).first()["chars"]
            lines.append([s, r["hit_5"], r["mrr_10"], chars])
        parts += [f"## {m}", bold_best_table(["size", "hit_5", "mrr_10", "chars_10"], lines)]
    return "\n\n".join(parts) + "\n"
