"""Evidence, relevance and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions.ids import stable_order
from lakequill.functions.text import normalize, sentences
from lakequill.operators.passages import holding
from lakequill.operators.sizes import small_or_shuffled
from lakequill.operators.store import materialized

KS = (1, 5, 10)
MRR_K = 10


def evidence(quotes: DataFrame, chunks: DataFrame, least_sentence: int = 20) -> DataFrame:
    """(question_id, chunk_id), distinct: the chunks of the question's page that hold a quote.

    quotes (question_id, page_id, quote), chunks (chunk_id, page_id, text). White space is folded on both sides. A quote
    that no chunk of the page holds whole counts where one of its sentences of 20 characters or more occurs.
    """
    asked = quotes.select("question_id", "page_id", normalize(F.col("quote")).alias("quote")).withColumn("nth", F.xxhash64("question_id", "page_id", "quote"))
    held = chunks.select("chunk_id", "page_id", normalize(F.col("text")).alias("text"))
    pairs = asked.join(held, "page_id")
    parts = F.filter(sentences(F.col("quote")), lambda s: F.length(s) >= least_sentence)
    judged = pairs.withColumns({"whole": F.col("text").contains(F.col("quote")), "part": F.exists(parts, lambda s: F.col("text").contains(s))}).drop("text")
    judged = judged.where("whole or part")
    any_whole = F.max("whole").over(Window.partitionBy("nth", "page_id", "question_id"))
    return judged.withColumn("any_whole", any_whole).where("whole or not any_whole").select("question_id", "chunk_id").distinct()


def passages_in(passages: DataFrame, docs: DataFrame, least: int = 1) -> DataFrame:
    """(question_id, chunk_id), distinct: the documents, of any page, that hold a whole passage; white space folded.

    No page joins the two here: blocks of documents meet blocks of passages, each text is read once and moves nowhere.
    The result is written, so that what reads it twice has it.
    """
    p = passages.select(F.col("item_id").alias("question_id"), normalize(F.col("text")).alias("quote")).where(F.length("quote") >= least)
    quotes = materialized(p.select("quote").distinct().select(F.monotonically_increasing_id().alias("id"), F.col("quote").alias("text")), "passages")
    found = materialized(holding(quotes, docs.select("id", normalize(F.col("text")).alias("text"))).distinct(), "passage-hits")
    asked = p.join(quotes, F.col("quote") == F.col("text")).select("question_id", F.col("id").alias("passage_id"))
    return small_or_shuffled(asked).join(found, "passage_id").select("question_id", F.col("text_id").alias("chunk_id")).distinct()


def lay_by_page(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """chunks (..., page_id) as a table in folders of page buckets, so that a question set reads its pages' folders only."""
    chunks.withColumn("page_bucket", page_bucket(F.col("page_id"), buckets)).repartition("page_bucket", "page_id").write.mode("overwrite").partitionBy("page_bucket").parquet(path)


def page_bucket(page: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(page.cast("string")), F.lit(buckets)).cast("int")


def texts_of(laid: DataFrame, pages: DataFrame, buckets: int) -> DataFrame:
    """(chunk_id, page_id, text) of some pages, few enough for a broadcast, from a table of lay_by_page."""
    near = pages.withColumn("page_bucket", page_bucket(F.col("page_id"), buckets)).where("page_bucket >= 0")  # a comparison: without one Spark prunes no folders
    return laid.join(F.broadcast(near), ["page_bucket", "page_id"]).select("chunk_id", "page_id", "text")


def sampled_evidence(questions: DataFrame, laid: DataFrame, wanted: int, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """(questions, qrels): the first `wanted` questions, by the SHA-1 of their ids, that a chunk of a candidate page answers.

    questions (question_id, page_id, quotes ...), laid: a table of lay_by_page with chunk_id and text. Candidate pages are
    those of the first 2 * wanted questions. Their buckets prune the folders while the plan runs, and no text of another
    page is looked at.
    """
    order = [stable_order(F.col("question_id")), F.col("question_id")]
    pages = materialized(questions.orderBy(*order).limit(2 * wanted).select("page_id").distinct(), "candidate-pages")  # 2 * wanted at most
    asked = questions.join(F.broadcast(pages), "page_id", "left_semi")
    texts = texts_of(laid, pages, buckets)
    qrels = materialized(evidence(asked.select("question_id", "page_id", F.explode("quotes").alias("quote")), texts), "qrels")
    sample = questions.join(qrels.select("question_id").distinct(), "question_id", "left_semi").orderBy(*order).limit(wanted)
    sample = materialized(sample, "sample")
    return sample, qrels.join(F.broadcast(sample.select("question_id")), "question_id", "left_semi")


def relevant_ranks(qrels: DataFrame, rankings: DataFrame) -> DataFrame:
    """qrels with the rank at which each relevant chunk stands, null where it doesn't."""
    best = rankings.groupBy(F.col("query_id").alias("question_id"), "chunk_id").agg(F.min("rank").alias("rank"))
    return qrels.select("question_id", "chunk_id").distinct().join(best, ["question_id", "chunk_id"], "left")


def per_question(qrels: DataFrame, rankings: DataFrame, ks: tuple[int, ...] = KS, recall_k: int | None = None, mrr_k: int = MRR_K) -> DataFrame:
    """(question_id, first_rank, hit_<k>..., recall, rr) of every question with relevance."""
    deepest = recall_k or (max(ks) if ks else mrr_k)
    by = relevant_ranks(qrels, rankings).groupBy("question_id").agg(
        F.min("rank").alias("first_rank"), (F.count_if(F.col("rank") <= deepest) / F.count(F.lit(1))).alias("recall")
    )
    hit = {f"hit_{k}": F.coalesce((F.col("first_rank") <= k).cast("int"), F.lit(0)) for k in ks}
    return by.withColumns(hit | {"rr": F.when(F.col("first_rank") <= mrr_k, 1 / F.col("first_rank")).otherwise(0.0)})


def metrics(qrels: DataFrame, rankings: DataFrame, ks: tuple[int, ...] = KS, mrr_k: int = MRR_K, by: DataFrame | None = None, group: str | None = None) -> DataFrame:
    """Means of hit@k, recall@max(k) and mrr@k over questions with relevance; all 0 if there is none. by (question_id, group): one row for each group."""
    rows = per_question(qrels, rankings, ks, mrr_k=mrr_k)
    recall = f"recall_{max(ks) if ks else mrr_k}"
    aggs = [*(F.coalesce(F.avg(f"hit_{k}"), F.lit(0.0)).alias(f"hit_{k}") for k in ks), F.coalesce(F.avg("recall"), F.lit(0.0)).alias(recall), F.coalesce(F.avg("rr"), F.lit(0.0)).alias(f"mrr_{mrr_k}"), F.count(F.lit(1)).alias("questions")]
    return rows.join(by, "question_id").groupBy(group).agg(*aggs) if group else rows.agg(*aggs)


def chars_at_k(rankings: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """One row (chars): the mean over ranked questions of the characters in their best k chunks; unknown chunks count 0."""
    sizes = chunks.select(F.col("id").alias("chunk_id"), F.length("text").alias("chars"))
    each = rankings.join(sizes, "chunk_id", "left").groupBy("query_id").agg(F.sum(F.when(F.col("rank") <= k, F.coalesce("chars", F.lit(0))).otherwise(0)).alias("chars"))
    return each.agg(F.coalesce(F.avg("chars"), F.lit(0.0)).alias("chars"))


def size_profile(chunks: DataFrame) -> DataFrame:
    """(size, chunks, mean_chars)."""
    return chunks.groupBy("size").agg(F.count(F.lit(1)).alias("chunks"), F.avg(F.length("text")).alias("mean_chars"))


def eval_questions(questions: DataFrame, qtype: str | None = None) -> DataFrame:
    """Test questions whose answer has been judged right; those not judged are left out."""
    kept = questions.where((F.col("answer_ok") == F.lit(True)) & (F.col("split") == "test"))
    return kept.where(F.col("qtype") == qtype) if qtype else kept


def stable_sample(questions: DataFrame, limit: int | None = None, key: str = "question_id", default: int = 2_000) -> DataFrame:
    """The first `limit` (0 or none: the default) by the SHA-1 of the key. Semi-join with the relevance first."""
    return questions.orderBy(stable_order(F.col(key)), key).limit(limit or default)


def rank_table(qrels: DataFrame, rankings: DataFrame, questions: DataFrame, methods: list[str]) -> DataFrame:
    """(question_id, qtype, question, one column for each method): the first relevant rank as text, '-' if there is none. rankings carry method."""
    best = rankings.join(qrels.withColumnRenamed("question_id", "query_id"), ["query_id", "chunk_id"], "left_semi")
    found = best.groupBy(F.col("query_id").alias("question_id")).pivot("method", methods).agg(F.min("rank"))
    rows = questions.select("question_id", "qtype", F.left("text", F.lit(80)).alias("question")).join(qrels.select("question_id").distinct(), "question_id", "left_semi")
    return rows.join(found, "question_id", "left").select("question_id", "qtype", "question", *(F.coalesce(F.col(m).cast("string"), F.lit("-")).alias(m) for m in methods))


def predictor_quality(rows: DataFrame, predicted: dict[str, str]) -> DataFrame:
    """(rule, precision, recall) of boolean rules against the column `truth`; an empty denominator counts as 1."""
    n = lambda c: F.count_if(c).cast("double")
    truth = F.col("truth")
    stats = [F.struct(F.lit(name).alias("rule"), (n(F.expr(rule) & truth) / F.greatest(n(F.expr(rule)), F.lit(1.0))).alias("precision"), (n(F.expr(rule) & truth) / F.greatest(n(truth), F.lit(1.0))).alias("recall")) for name, rule in predicted.items()]
    return rows.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")
