"""Assembly of the question release: kept items, answered rows, unanswerable, comparing, listing and table questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions.ids import crc, pick, question_id, split_of
from lakequill.functions.text import title_norm, question_norm
from lakequill.operators import qa


def ambiguous(questions: DataFrame, nearest: DataFrame, threshold: float = 0.98) -> DataFrame:
    """questions (key, page_id, question) with ambiguous_across_pages: its normalised text is on another page too, or its nearest question there is that similar."""
    repeated = qa.repeated_across_pages(questions).select("question_norm", F.lit(True).alias("repeated"))
    near = nearest.where(F.col("similarity") >= threshold).select("key", F.lit(True).alias("near"))
    joined = questions.withColumn("question_norm", question_norm(F.col("question"))).join(repeated, "question_norm", "left").join(near, "key", "left")
    return joined.withColumn("ambiguous_across_pages", qa.false_if_null(F.col("repeated")) | qa.false_if_null(F.col("near"))).drop("question_norm", "repeated", "near")


def kept_items(corpus: DataFrame, challenge: DataFrame) -> DataFrame:
    """(page_id, kind, src_j, question): corpus items to keep that fit one page, challenge items that pass and aren't likely ambiguous."""
    a = corpus.where("verdict = 'keep' and not ambiguous_across_pages").select("page_id", F.lit("corpus").alias("kind"), F.col("j").alias("src_j"), "question")
    b = challenge.where("challenge_ok and not likely_ambiguous").select("page_id", F.lit("challenge").alias("kind"), F.col("j").alias("src_j"), "question")
    return a.unionByName(b)


def all_criteria(items: DataFrame, labels: str, criteria: Sequence[str]) -> DataFrame:
    """Rows of pages whose judge gave a label to every item, where every criterion holds. labels: array of structs beside the array items."""
    paired = items.where(F.size("items") == F.size(labels)).select("page_id", F.posexplode(F.arrays_zip("items", labels)).alias("j", "x"))
    ok = F.lit(True)
    for c in criteria:
        ok = ok & F.col(f"x.{labels}.{c}")
    return paired.where(qa.false_if_null(ok)).select("page_id", "j", F.col("x.items").alias("item"))


def keyed_questions(*layers: tuple[str, DataFrame]) -> DataFrame:
    """(key, page_id, question) of several layers, keys prefixed by the layer's letter."""
    out = None
    for letter, df in layers:
        part = df.select(F.concat_ws("|", F.lit(letter), F.col("page_id").cast("string"), F.col("j").cast("string")).alias("key"), "page_id", "question")
        out = part if out is None else out.unionByName(part)
    return out


def rag_rows(kept: DataFrame, pages: DataFrame, answers: DataFrame, judged: DataFrame, ranks: DataFrame, qrels: DataFrame, targets: Sequence[str]) -> DataFrame:
    """One row a kept question: place metadata, the current answer, its judgement, ranks, pooled relevance, split. Absent layers are null."""
    n = F.row_number().over(_within("page_id", "kind", "src_j")) - 1
    current = qa.current_answers(answers, kept).drop("question")
    rows = kept.withColumn("n", n).join(pages, "page_id").join(current, ["page_id", "kind", "src_j"], "left")
    rows = rows.withColumn("question_id", question_id(F.col("page_id"), F.col("kind"), F.col("n")))
    for layer in (judged, ranks, qrels):
        rows = rows.join(layer, "question_id", "left")
    title = title_norm(F.col("title"))
    rows = rows.withColumns(
        {
            "split": split_of(F.col("wikidata_id")), "x_language": qa.other_language(list(targets), F.col("language"), F.concat_ws("|", "page_id", F.col("n").cast("string"))),
            "title_in_question": (title != "") & question_norm(F.col("question")).contains(title), "qrels_judged": F.col("n_relevant").isNotNull(),
        }
    )
    return rows


def _within(key: str, *order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def final_answer(computed: Column, confirmed: Column, correction: Column) -> Column:
    """The computed answer if a judge confirmed it, else the correction."""
    return F.when(qa.false_if_null(confirmed), computed).otherwise(correction)


def meta_specs(items: DataFrame, near: DataFrame, languages: Sequence[str], kinds: Sequence[str] = ("count", "list"), radii: Sequence[int] = (5, 10, 25), anchors: int = 4_000) -> DataFrame:
    """List specs (items of a category and country) and geo specs (places around an anchor), each with the language, form and gold pages that its key's hash picks."""
    lists = qa.list_specs(items).select(F.concat_ws("|", F.lit("list"), "category", F.col("country").cast("string")).alias("key"), "ids")
    chosen = near.select("anchor_id").distinct().orderBy(crc(F.col("anchor_id")), "anchor_id").limit(anchors)
    radius = pick(F.array(*map(F.lit, radii)), F.col("anchor_id"))
    around = near.join(chosen, "anchor_id", "left_semi").where(F.col("km") <= radius).groupBy("anchor_id").agg(F.array_sort(F.collect_list("place_id")).alias("ids"))
    geo = around.where(F.size("ids").between(2, 20)).select(F.concat_ws("|", F.lit("geo"), F.col("anchor_id").cast("string")).alias("key"), F.col("ids").cast(dict(lists.dtypes)["ids"]).alias("ids"))
    both = lists.unionByName(geo)
    return both.withColumns({"language": pick(F.array(*map(F.lit, languages)), F.col("key")), "form": pick(F.array(*map(F.lit, kinds)), F.concat("key", F.lit("|form")))})


def qrel_jobs(challenge: DataFrame, corpus: DataFrame, unanswerable: DataFrame, most: int = 400) -> DataFrame:
    """(page_id, question, tier): challenge items, corpus items of the balanced pages and checked unanswerable ones, the balanced first."""
    balanced = qa.balanced_subset(corpus.select("lang", "page_id"), "lang", "page_id", most).select("page_id", F.lit(True).alias("balanced"))
    rows = challenge.select("page_id", "question").unionByName(corpus.join(balanced, "page_id", "left_semi").select("page_id", "question")).unionByName(unanswerable.where("ok").select("page_id", "question"))
    return rows.distinct().join(balanced, "page_id", "left").select("page_id", "question", F.when(F.col("balanced"), 0).otherwise(1).alias("tier"))


def prompt_items(items: DataFrame, pages: DataFrame, most_chars: int = 12_000) -> DataFrame:
    """(page_id, prompt parts): the items as JSON lines, the article's start, and the words that a question must avoid, in order and once each."""
    lines = items.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("j", F.to_json(F.struct("j", "question")).alias("line")))), lambda x: x["line"]), "\n").alias("items"))
    words = F.array_distinct(F.concat(F.coalesce("distinctive", F.array().cast("array<string>")), F.split(question_norm(F.col("title")), " ")))
    return lines.join(pages, "page_id").select("page_id", "items", F.left("text", F.lit(most_chars)).alias("article"), words.alias("forbidden"))


def batch_problems(expected: DataFrame, got: DataFrame, facts: tuple[int, int] = (1, 3)) -> DataFrame:
    """(page_id, j, problem): labels that are missing or unexpected, and items with too few or too many facts."""
    joined = expected.withColumn("e", F.lit(True)).join(got.withColumn("g", F.lit(True)), ["page_id", "j"], "full")
    problem = F.when(F.col("g").isNull(), "missing").when(F.col("e").isNull(), "unexpected").when(~F.size("facts").between(*facts), "facts")
    return joined.select("page_id", "j", problem.alias("problem")).where("problem is not null")


def page_lead(pages: DataFrame, most_chars: int = 1_000) -> DataFrame:
    """(page_id, text): what a page's vector is made of, its title and the start of its text."""
    return pages.select("page_id", F.concat_ws("\n", "title", F.left("text", F.lit(most_chars))).alias("text"))


def question_ranks(questions: DataFrame, docs: DataFrame, query_vectors: DataFrame, page_vectors: DataFrame, cap: int = 100) -> DataFrame:
    """(query_id, bm25_rank, dense_rank, margin) of each question's own page; the dense part is null where a vector is missing.

    questions (query_id, text, own_id), docs (id, text), query_vectors (query_id, vec), page_vectors (chunk_id, vec).
    """
    from lakequill.operators.dense import own_rank_margin
    from lakequill.operators.sparse import own_rank

    asked = query_vectors.join(questions.select("query_id", "own_id"), "query_id")
    return own_rank(questions, docs, cap).join(own_rank_margin(asked, page_vectors), "query_id", "left").select("query_id", "bm25_rank", "dense_rank", "margin")


def with_language_flags(flagged: DataFrame, items: DataFrame, is_language: Column, is_english: Column) -> DataFrame:
    """Rule flags with q_lang and en_lang from a detector: two boolean columns of items (page_id, n); null means the language isn't known and skips the check."""
    extra = F.array_compact(F.array(F.when(~is_language, F.lit("q_lang")), F.when(~is_english, F.lit("en_lang"))))
    return flagged.join(items.select("page_id", "n", extra.alias("__more")), ["page_id", "n"], "left").select("page_id", "n", F.concat("flags", F.coalesce("__more", F.array().cast("array<string>"))).alias("flags"))
