"""The answered rows of a release: a page's layers joined by page in their buckets, then one row for each current answer.

A layer is a table with one row for each page. All are stored in as many buckets of the page id, sorted by it, so that
the left joins of all layers read bucket beside bucket and shuffle nothing. What belongs to one item of a page is found
in the page's own arrays and maps.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions.ids import crc, split_of
from lakequill.functions.text import question_norm, title_norm
from lakequill.operators import quotes
from lakequill.operators.qa import RAG_CRITERIA, false_if_null
from lakequill.plans.release import final_answer

BUCKETS = 32
#: A page of fewer characters is a stub.
STUB_CHARS = 2_000
#: The layers and their columns beside page_id. Only pages and answers must have a row.
LAYERS: Mapping[str, str] = {
    "pages": "wikidata_id string, url string, title string, language string, country string, categories array<string>, machine_generated boolean, sitelinks int, latitude double, longitude double, text string",
    "answers": "items array<struct<kind:string,src_j:int,question:string,answer:string,qtype:string,evidence:array<string>,x_lang:string,question_x:string,answer_x:string>>",
    "sources": "sources array<struct<kind:string,src_j:int,question:string,labels:map<string,string>>>",
    "judge_a": f"judge_a array<struct<{','.join(c + ':boolean' for c in RAG_CRITERIA)}>>",
    "judge_b": f"judge_b array<struct<{','.join(c + ':boolean' for c in RAG_CRITERIA)}>>",
    "ranks": "ranks map<string,struct<dense:int,margin:double,bm25:int>>",
    "tags": "page_tags map<string,string>",
    "similarity": "page_template_sim double",
    "lexical": "lexical map<int,double>",
    "variants": "variants array<struct<question:string,time_sensitive:boolean,reasoning:string,keyword:string,typo:string,verbose:string,history:string,followup:string,check:string>>",
    "qrels": "qrels map<string,array<struct<id:string,match:string,answers:boolean,bm25_rank:int>>>",
}


def save_layers(layers: Mapping[str, DataFrame], prefix: str, buckets: int = BUCKETS) -> None:
    """Each layer (page_id, its columns) as the table <prefix>_<name> of the warehouse, in buckets of the page id; a layer that is left out is an empty table."""
    for name, columns in LAYERS.items():
        kind = next(iter(layers.values())).schema["page_id"].dataType.simpleString()
        df = layers[name] if name in layers else next(iter(layers.values())).sparkSession.createDataFrame([], f"page_id {kind}, {columns}")
        df.repartition(buckets, "page_id").write.mode("overwrite").bucketBy(buckets, "page_id").sortBy("page_id").saveAsTable(f"{prefix}_{name}")


def joined_layers(spark: SparkSession, prefix: str) -> DataFrame:
    """A row for each page that has answers, with all layers; the merge join is asked for, as a broadcast would give the buckets up."""
    out = None
    for name in LAYERS:
        layer = spark.table(f"{prefix}_{name}").hint("merge")
        out = layer if out is None else out.join(layer, "page_id", "inner" if name == "answers" else "left")
    return out


def pooled(cands: Column, own: Column) -> Column:
    """A struct of the pooled relevance of one question: cands are its judged pages (id, match, answers, bm25_rank), own is its gold page. Without a judged pool all but qrels_judged is null."""
    ids = lambda c: F.transform(c, lambda x: x["id"])
    other = F.filter(cands, lambda c: c["id"] != own)
    gold = F.get(F.filter(cands, lambda c: c["id"] == own), F.lit(0))
    yes = F.filter(other, lambda c: c["match"] == "yes")
    hard = F.array_sort(F.transform(F.filter(other, lambda c: (c["match"] == "no") & (c["bm25_rank"] > 0)), lambda c: F.struct(c["bm25_rank"].alias("r"), c["id"].alias("id"))))
    n = F.size(yes) + 1
    fields = {
        "gold_match": gold["match"], "gold_answers": gold["answers"], "relevant": ids(yes), "partial": ids(F.filter(other, lambda c: c["match"] == "partly")), "answering": ids(F.filter(cands, lambda c: c["answers"])),
        "hard_negatives": F.slice(ids(hard), 1, 10), "n_relevant": n, "hits": F.when(n == 1, "unique").when(n <= 3, "few").otherwise("many"), "pool_saturated": F.size(F.filter(other, lambda c: c["match"] != "no")) >= 10,
    }
    return F.struct(cands.isNotNull().alias("qrels_judged"), *(F.when(cands.isNotNull(), c).alias(name) for name, c in fields.items()))


def answered_rows(spark: SparkSession, prefix: str) -> DataFrame:
    """One row for each answer whose source question still reads as it did: metadata, texts, evidence, labels, judgement, ranks, tags, variants, pooled relevance.

    Judges count if they gave labels to all answers of the page. A criterion holds if every such judge says so; answer_ok
    leaves x_ok out, which is null unless both judged. Absent layers are null.
    """
    p = joined_layers(spark, prefix)
    judged = lambda c: F.size(F.col(c)) == F.size(F.col("all"))
    rows = p.select("*", F.col("items").alias("all"), F.posexplode("items").alias("n", "it")).drop("items")
    source = F.get(F.filter("sources", lambda s: (s["kind"] == F.col("it.kind")) & (s["src_j"] == F.col("it.src_j"))), F.lit(0))
    variant = F.get(F.filter("variants", lambda v: v["question"] == F.col("it.question")), F.lit(0))
    labels = F.array_compact(F.array(*(F.when(judged(j), F.get(F.col(j), F.col("n"))) for j in ("judge_a", "judge_b"))))
    rows = rows.select("*", source.alias("src"), variant.alias("v"), labels.alias("judgements"), F.col("qrels")[F.lower(F.lpad(F.hex(crc(F.col("it.question"))), 8, "0"))].alias("cands"))
    rows = rows.where(F.col("src.question") == F.col("it.question"))
    every = lambda c: F.forall("judgements", lambda j: false_if_null(j[c]))
    criteria = F.when(F.size("judgements") > 0, F.struct(*(every(c).alias(c) for c in RAG_CRITERIA)))
    ok = F.lit(True)
    for c in RAG_CRITERIA:
        ok = ok & every(c) if c != "x_ok" else ok
    rows = rows.select("*", quotes.spans(F.col("text"), F.col("it.evidence")).alias("found"), criteria.alias("criteria"), pooled(F.col("cands"), F.col("page_id").cast("string")).alias("pool"))
    first = F.get("found.spans", F.lit(0))
    title = title_norm(F.col("title"))
    rank = lambda way: F.col("ranks")[F.concat(F.col("n").cast("string"), F.lit("|" + way))]
    shown = F.struct(*(F.col(f"v.{k}").alias(k) for k in ("keyword", "typo", "verbose", "history", "followup", "check")), (F.col("it.qtype") != "identify").alias("followup_applicable"))
    return rows.select(
        "page_id", "n", "it.kind", F.col("language").alias("lang"), "wikidata_id", "url", "title", "country", "categories", "machine_generated", "sitelinks", "latitude", "longitude", F.length("text").alias("char_count"),
        "it.question", "it.answer", "it.qtype", "it.evidence", F.col("found.spans").alias("spans"), F.col("found.ok").alias("verbatim"), quotes.evidence_position(F.col("text"), first).alias("evidence_pos"),
        F.exists("found.spans", lambda s: _in_table(F.col("text"), s)).alias("evidence_in_table"), F.col("src.labels").alias("labels"), "criteria", F.size("judgements").alias("judges"), F.when(F.size("judgements") > 0, ok).alias("answer_ok"),
        "it.x_lang", "it.question_x", "it.answer_x", F.when(F.size("judgements") == 2, F.col("criteria.x_ok")).alias("x_ok"), rank("o").alias("rank_o"), rank("x").alias("rank_x"), split_of(F.col("wikidata_id")).alias("split"),
        (F.length("text") < STUB_CHARS).alias("stub"), "page_template_sim", "page_tags", ((title != "") & question_norm(F.col("it.question")).contains(title)).alias("title_in_question"), F.col("lexical")[F.col("n")].alias("lex_overlap"),
        "v.time_sensitive", "v.reasoning", F.when(F.col("v").isNotNull(), shown).alias("variants"), "pool.*",
    )


def _in_table(text: Column, span: Column) -> Column:
    """Whether the line in which the span starts begins with a bar."""
    at = span[0].cast("int")
    return F.concat(F.substring_index(F.left(text, at), "\n", -1), F.substring(text, at + 1, F.lit(1))).startswith("|")


def _all_true(check: str) -> Column:
    return F.forall(F.map_values(F.col(check)), lambda v: false_if_null(v))


def unanswerable_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items (page_id, question, check map, cands) with lang, title, the pooled relevance, ok and split: all checks passed, the pool is judged and none of it answers. An unjudged pool isn't ok."""
    rows = items.join(pages.select("page_id", "wikidata_id", "title", F.col("language").alias("lang")), "page_id").select("*", pooled(F.col("cands"), F.col("page_id").cast("string")).alias("pool"))
    ok = _all_true("check") & F.col("pool.qrels_judged") & (F.size("pool.answering") == 0)
    return rows.select(*items.drop("cands").columns, "lang", "title", "pool.*", false_if_null(ok).alias("ok"), split_of(F.col("wikidata_id")).alias("split"))


def comparing_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items (page_id, check map, verbatim ...) with lang, ok and split: all checks passed and the evidence is verbatim."""
    rows = items.join(pages.select("page_id", "wikidata_id", F.col("language").alias("lang")), "page_id")
    return rows.select(*items.columns, "lang", false_if_null(_all_true("check") & F.col("verbatim")).alias("ok"), split_of(F.col("wikidata_id")).alias("split"))


def listing_rows(items: DataFrame, pages: DataFrame) -> DataFrame:
    """items (key, anchor, gold array, check map ...) with ok, n_gold and split: by the place of the anchor page, or by the key where there is none."""
    anchors = pages.select(F.col("page_id").alias("anchor"), "wikidata_id")
    rows = items.join(anchors, "anchor", "left")
    return rows.select(*items.columns, _all_true("check").alias("ok"), F.size("gold").alias("n_gold"), F.when(F.col("anchor").isNotNull(), split_of(F.col("wikidata_id"))).otherwise(split_of(F.col("key"))).alias("split"))


def table_rows(items: DataFrame, pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """items (page_id, table, n, answer ...) with the verdict (answer_correct, question_ok, your_answer, note) where a judge gave one, answer_final, answer_source, ok and split.

    A confirmed answer is final, else the judge's own one; what nobody has checked has no final answer and isn't ok.
    """
    keys: Sequence[str] = ("page_id", "table", "n")
    v = verdicts.select(*keys, F.struct("answer_correct", "question_ok", "your_answer", "note").alias("verdict"))
    rows = items.join(pages.select("page_id", "wikidata_id", "title", F.col("language").alias("lang")), "page_id").join(v, list(keys), "left")
    there = F.col("verdict").isNotNull()
    final = F.when(there, final_answer(F.col("answer"), F.col("verdict.answer_correct"), F.col("verdict.your_answer")))
    by = F.when(~there, "unverified").when(false_if_null(F.col("verdict.answer_correct")), "computed").otherwise("judge")
    return rows.select(*items.columns, "title", "lang", there.alias("checked"), "verdict", final.alias("answer_final"), by.alias("answer_source"), (there & false_if_null(F.col("verdict.question_ok"))).alias("ok"), split_of(F.col("wikidata_id")).alias("split"))
