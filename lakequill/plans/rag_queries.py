"""Driver queries of the answered rows and the other files of a release. Documents are pages; their layers follow from ids and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions.ids import crc
from lakequill.operators.qa import RAG_CRITERIA
from lakequill.plans import rag_rows
from lakequill.plans.build_queries import CRC, CRC_TABLE
from lakequill.plans.registry import query



def _d() -> Column:
    return F.col("doc_id")


def _pages(t) -> DataFrame:
    return t("documents").select(
        _d().alias("page_id"), F.concat(F.lit("Q"), _d().cast("string")).alias("wikidata_id"), F.concat(F.lit("https://example.org/"), _d().cast("string")).alias("url"), F.concat(F.lit("Place "), _d().cast("string"), F.lit(" (hill)")).alias("title"),
        F.col("lang").alias("language"), F.col("source").alias("country"), F.array("source").alias("categories"), (_d() % 9 == 0).alias("machine_generated"), (_d() % 30).cast("int").alias("sitelinks"), (_d() % 90).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), "text",
    )


def _question(k: Column) -> Column:
    return F.concat(F.when(k == 0, F.concat(F.lit("Where is place "), _d().cast("string"))).otherwise(F.lit("What is here")), F.lit(" item "), k.cast("string"), F.lit("?"))


def _each(n: Column, make) -> Column:
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), make)


def _layers(t) -> dict[str, DataFrame]:
    d = t("documents").select("doc_id")
    n = _d() % 3 + 1
    text = lambda c: c.cast("string")
    answers = _each(n, lambda k: F.struct(F.lit("corpus").alias("kind"), k.alias("src_j"), _question(k).alias("question"), F.concat(F.lit("answer "), text(k)).alias("answer"), F.when(k == 1, "identify").otherwise("fact").alias("qtype"), F.array(F.lit("never in a text 0815")).alias("evidence"), F.lit("sl").alias("x_lang"), F.lit("qx").alias("question_x"), F.lit("ax").alias("answer_x")))
    sources = _each(n, lambda k: F.struct(F.lit("corpus").alias("kind"), k.alias("src_j"), F.when((_d() + k) % 5 == 0, F.lit("repaired since")).otherwise(_question(k)).alias("question"), F.create_map(F.lit("verdict"), F.lit("keep")).alias("labels")))
    judge = lambda shift, size: _each(size, lambda k: F.struct(*(((_d() + k + shift) % (i + 5) != 0).alias(c) for i, c in enumerate(RAG_CRITERIA))))
    ranks = F.map_from_entries(_each(n, lambda k: F.struct(F.concat(text(k), F.lit("|o")).alias("key"), F.struct((_d() % 100).cast("int").alias("dense"), F.lit(0.5).alias("margin"), (k + 1).alias("bm25")).alias("value"))))
    variants = F.filter(_each(n, lambda k: F.struct(_question(k).alias("question"), (k == 0).alias("time_sensitive"), F.lit("single").alias("reasoning"), *(F.lit(x).alias(x) for x in ("keyword", "typo", "verbose", "history", "followup", "check")))), lambda v: _d() % 2 == 0)
    pool = _each(F.lit(14), lambda c: F.struct(F.when(c == 3, text(_d())).otherwise(F.concat(F.lit("p"), text(c))).alias("id"), F.element_at(F.array(F.lit("yes"), F.lit("partly"), F.lit("no")), F.greatest(F.lit(1), ((_d() + c) % (_d() % 7 + 1)).cast("int") % 3 + 1)).alias("match"), ((_d() + c) % 4 == 0).alias("answers"), F.when(c % 3 != 1, F.lit(20) - c).alias("bm25_rank")))
    qrels = F.map_from_entries(F.filter(_each(n, lambda k: F.struct(F.lower(F.lpad(F.hex(crc(_question(k))), 8, "0")).alias("key"), pool.alias("value"))), lambda e: _d() % 4 != 1))
    row = lambda name, c, cond: d.where(cond).select(_d().alias("page_id"), c.alias(name))
    every = F.lit(True)
    return {
        "pages": _pages(t), "answers": row("items", answers, _d() % 6 != 5), "sources": row("sources", sources, every), "judge_a": row("judge_a", judge(0, n), _d() % 3 != 2), "judge_b": row("judge_b", judge(1, F.when(_d() % 8 == 0, n + 1).otherwise(n)), _d() % 5 != 4), "ranks": row("ranks", ranks, _d() % 2 == 1),
        "tags": row("page_tags", F.create_map(F.lit("history"), text(_d() % 2 == 0)), _d() % 3 == 0), "similarity": row("page_template_sim", F.round(_d() % 100 / 100, 2), every), "lexical": row("lexical", F.map_from_entries(_each(n, lambda k: F.struct(k.alias("key"), (k / 4).alias("value")))), every), "variants": row("variants", variants, every), "qrels": row("qrels", qrels, every),
    }


_CRITERIA_SQL = ", ".join(f"((doc_id + k + {{0}}) % {i + 5} <> 0)" for i in range(len(RAG_CRITERIA)))
_POOLED = """
    c AS (SELECT {key}, doc_id, i, CASE WHEN i = 3 THEN doc_id::VARCHAR ELSE 'p' || i END AS id, (['yes', 'partly', 'no'])[greatest(1, ((doc_id + i) % (doc_id % 7 + 1)) % 3 + 1)] AS m, (doc_id + i) % 4 = 0 AS ans, CASE WHEN i % 3 <> 1 THEN 20 - i END AS rk
          FROM {base} AS b, range(14) AS r(i) WHERE {judged}),
    pool AS (SELECT {key}, max(m) FILTER (i = 3) AS gold_match, bool_or(ans) FILTER (i = 3) AS gold_answers, coalesce(string_agg(id, ',' ORDER BY i) FILTER (i <> 3 AND m = 'yes'), '') AS relevant,
          coalesce(string_agg(id, ',' ORDER BY i) FILTER (i <> 3 AND m = 'partly'), '') AS partial, coalesce(string_agg(id, ',' ORDER BY i) FILTER (ans), '') AS answering,
          array_to_string((list(id ORDER BY rk) FILTER (i <> 3 AND m = 'no' AND rk > 0))[1:10], ',') AS hard, 1 + count(*) FILTER (i <> 3 AND m = 'yes') AS n_relevant, count(*) FILTER (i <> 3 AND m <> 'no') >= 10 AS pool_saturated FROM c GROUP BY {key})"""
_POOL_COLUMNS = "gold_match, gold_answers, relevant, partial, answering, CASE WHEN pool.n_relevant IS NOT NULL THEN coalesce(hard, '') END AS hard_negatives, n_relevant::INTEGER AS n_relevant, CASE WHEN n_relevant = 1 THEN 'unique' WHEN n_relevant <= 3 THEN 'few' WHEN n_relevant > 3 THEN 'many' END AS hits, pool_saturated"


def _joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@query(
    rf"""WITH b AS (SELECT doc_id, lang, source, text, k, doc_id % 3 + 1 AS size, (CASE WHEN k = 0 THEN 'Where is place ' || doc_id ELSE 'What is here' END) || ' item ' || k || '?' AS q FROM documents, range(3) AS r(k) WHERE k <= doc_id % 3 AND doc_id % 6 <> 5 AND (doc_id + k) % 5 <> 0),
    j AS (SELECT *, CASE WHEN doc_id % 3 <> 2 THEN [{_CRITERIA_SQL.format(0)}] END AS ja, CASE WHEN doc_id % 5 <> 4 AND doc_id % 8 <> 0 THEN [{_CRITERIA_SQL.format(1)}] END AS jb FROM b),
    g AS (SELECT *, (ja IS NOT NULL)::INTEGER + (jb IS NOT NULL)::INTEGER AS judges, [coalesce(ja[i], true) AND coalesce(jb[i], true) FOR i IN range(1, {len(RAG_CRITERIA) + 1})] AS cr FROM j), {_POOLED.format(key="doc_id, k", base="g", judged="doc_id % 4 <> 1")},
    {CRC_TABLE}
    SELECT doc_id AS page_id, k::INTEGER AS n, 'corpus' AS kind, lang, 'Q' || doc_id AS wikidata_id, source AS country, (doc_id % 9 = 0) AS machine_generated, length(coalesce(text, '')) AS char_count, q AS question, 'answer ' || k AS answer, CASE WHEN k = 1 THEN 'identify' ELSE 'fact' END AS qtype,
      false AS verbatim, false AS evidence_in_table, 'keep' AS verdict, judges, CASE WHEN judges > 0 THEN array_to_string(cr, ',') END AS criteria, CASE WHEN judges > 0 THEN len([x FOR x IN cr[1:{len(RAG_CRITERIA) - 1}] IF NOT x]) = 0 END AS answer_ok, CASE WHEN judges = 2 THEN cr[{len(RAG_CRITERIA)}] END AS x_ok,
      CASE WHEN doc_id % 2 = 1 THEN (doc_id % 100)::INTEGER END AS dense_rank, CASE WHEN doc_id % 2 = 1 THEN (k + 1)::INTEGER END AS bm25_rank, CASE WHEN {CRC.format("'Q' || doc_id")} % 5 = 0 THEN 'dev' ELSE 'test' END AS split, length(coalesce(text, '')) < 2000 AS stub, round((doc_id % 100) / 100.0, 2)::DOUBLE AS page_template_sim,
      CASE WHEN doc_id % 3 = 0 THEN (doc_id % 2 = 0)::VARCHAR END AS history_tag, k = 0 AS title_in_question, (k / 4.0)::DOUBLE AS lex_overlap, CASE WHEN doc_id % 2 = 0 THEN k = 0 END AS time_sensitive, CASE WHEN doc_id % 2 = 0 THEN k <> 1 END AS followup_applicable, pool.n_relevant IS NOT NULL AS qrels_judged, {_POOL_COLUMNS}
    FROM g LEFT JOIN pool USING (doc_id, k), t"""
)
def answered_rows(t) -> DataFrame:
    """Eleven layers in buckets of the page, written once and joined without a shuffle."""
    layers = _layers(t)
    spark, prefix = layers["pages"].sparkSession, f"layers_{uuid.uuid4().hex}"
    layers["pages"] = layers["pages"].withColumn("text", F.coalesce("text", F.lit("")))
    rag_rows.save_layers(layers, prefix, 8)
    rows = rag_rows.answered_rows(spark, prefix)
    shown = rows.withColumns({"verdict": F.col("labels")["verdict"], "criteria": F.array_join(F.array(*(F.col(f"criteria.{c}").cast("string") for c in RAG_CRITERIA)), ","), "dense_rank": F.col("rank_o.dense"), "bm25_rank": F.col("rank_o.bm25"), "history_tag": F.col("page_tags")["history"], "followup_applicable": F.col("variants.followup_applicable")})
    shown = shown.withColumn("criteria", F.when(F.col("judges") > 0, F.col("criteria")))
    return _joined(shown, "relevant", "partial", "answering", "hard_negatives").select(
        "page_id", "n", "kind", "lang", "wikidata_id", "country", "machine_generated", "char_count", "question", "answer", "qtype", "verbatim", "evidence_in_table", "verdict", "judges", "criteria", "answer_ok", "x_ok", "dense_rank", "bm25_rank", "split", "stub", "page_template_sim", "history_tag", "title_in_question",
        "lex_overlap", "time_sensitive", "followup_applicable", "qrels_judged", "gold_match", "gold_answers", "relevant", "partial", "answering", "hard_negatives", "n_relevant", "hits", "pool_saturated",
    )


def _check() -> Column:
    """A map of checks: one is null where an id is divisible by 11."""
    return F.create_map(F.lit("a"), _d() % 7 != 0, F.lit("b"), F.when(_d() % 11 != 0, _d() % 5 != 0))


_CHECK_SQL = "doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND doc_id % 5 <> 0"


@query(
    f"""WITH g AS (SELECT doc_id, lang FROM documents), {_POOLED.format(key="doc_id", base="g", judged="doc_id % 4 <> 1")}, {CRC_TABLE}
    SELECT doc_id AS page_id, lang, 'Place ' || doc_id || ' (hill)' AS title, pool.n_relevant IS NOT NULL AS qrels_judged, {_POOL_COLUMNS}, {_CHECK_SQL} AND pool.n_relevant IS NOT NULL AND answering = '' AS ok,
           CASE WHEN {CRC.format("'Q' || doc_id")} % 5 = 0 THEN 'dev' ELSE 'test' END AS split FROM g LEFT JOIN pool USING (doc_id), t"""
)
def unanswerable_rows(t) -> DataFrame:
    pools = _layers(t)["qrels"].select("page_id", F.get(F.map_values("qrels"), F.lit(0)).alias("cands"))
    items = t("documents").select(_d().alias("page_id"), _check().alias("check")).join(pools, "page_id", "left")
    return _joined(rag_rows.unanswerable_rows(items, _pages(t)).drop("check"), "relevant", "partial", "answering", "hard_negatives")


_SPLIT_SQL = f"CASE WHEN {CRC.format('{0}')} % 5 = 0 THEN 'dev' ELSE 'test' END AS split"


@query(f"WITH {CRC_TABLE} SELECT doc_id AS page_id, lang, doc_id % 3 <> 0 AS verbatim, {_CHECK_SQL} AND doc_id % 3 <> 0 AS ok, {_SPLIT_SQL.replace('{0}', chr(39) + 'Q' + chr(39) + ' || doc_id')} FROM documents, t")
def comparing_rows(t) -> DataFrame:
    return rag_rows.comparing_rows(t("documents").select(_d().alias("page_id"), _check().alias("check"), (_d() % 3 != 0).alias("verbatim")), _pages(t)).drop("check")


@query(f"WITH {CRC_TABLE} SELECT 'list|' || doc_id AS key, {_CHECK_SQL} AS ok, (doc_id % 4 + 1)::INTEGER AS n_gold, {_SPLIT_SQL.replace('{0}', 'CASE WHEN doc_id % 2 = 0 THEN ' + chr(39) + 'Q' + chr(39) + ' || doc_id ELSE ' + chr(39) + 'list|' + chr(39) + ' || doc_id END')} FROM documents, t")
def listing_rows(t) -> DataFrame:
    gold = F.transform(F.sequence(F.lit(0).cast("bigint"), _d() % 4), lambda x: x)
    items = t("documents").select(F.concat(F.lit("list|"), _d().cast("string")).alias("key"), F.when(_d() % 2 == 0, _d()).alias("anchor"), gold.alias("gold"), _check().alias("check"))
    return rag_rows.listing_rows(items, _pages(t)).select("key", "ok", "n_gold", "split")


@query(
    f"""WITH {CRC_TABLE} SELECT doc_id AS page_id, n::INTEGER AS n, 'Place ' || doc_id || ' (hill)' AS title, lang, doc_id % 3 <> 0 AS checked, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN (doc_id + n) % 4 <> 0 THEN 'computed ' || n ELSE 'judge ' || doc_id END END AS answer_final,
      CASE WHEN doc_id % 3 = 0 THEN 'unverified' WHEN (doc_id + n) % 4 <> 0 THEN 'computed' ELSE 'judge' END AS answer_source, doc_id % 3 <> 0 AND doc_id % 5 <> 0 AS ok, {_SPLIT_SQL.replace('{0}', chr(39) + 'Q' + chr(39) + ' || doc_id')} FROM documents, range(2) AS r(n), t"""
)
def table_rows(t) -> DataFrame:
    items = t("documents").select(_d().alias("page_id"), F.lit(1).alias("table"), F.explode(F.array(F.lit(0), F.lit(1))).alias("n")).withColumn("answer", F.concat(F.lit("computed "), F.col("n").cast("string")))
    p = F.col("page_id")
    verdicts = items.where(p % 3 != 0).select("page_id", "table", "n", ((p + F.col("n")) % 4 != 0).alias("answer_correct"), F.when(p % 7 != 0, p % 5 != 0).otherwise(p % 5 != 0).alias("question_ok"), F.concat(F.lit("judge "), p.cast("string")).alias("your_answer"), F.lit("").alias("note"))
    return rag_rows.table_rows(items, _pages(t), verdicts).select("page_id", "n", "title", "lang", "checked", "answer_final", "answer_source", "ok", "split")
