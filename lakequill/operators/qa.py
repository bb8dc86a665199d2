"""Rules, labels, pools and picks of a question-set build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions.ids import crc, pick
from lakequill.operators.similar import earlier_similar
from lakequill.operators.store import placed
from lakequill.operators.xor_search import least_hash_partner

#: Label names of the question labels, in their order.
POSITIVE_LABELS = ("language_ok", "fluent", "realistic", "unique_place", "facts_answer", "translation_ok", "query_ok")
NEGATIVE_LABELS = ("duplicate", "self_answering")
CHALLENGE_LABELS = ("language_ok", "fluent", "unique_place", "facts_answer", "translation_ok", "query_ok")
RAG_CRITERIA = ("answered", "complete", "grounded", "concise", "language_ok", "quotes_ok", "x_ok")


def false_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def challenge_ok(supported: str = "facts_supported", self_answering: str = "self_answering", flags: Sequence[str] = CHALLENGE_LABELS) -> Column:
    """Facts supported, not self-answering, all other flags set; unlabelled rows aren't."""
    out = (F.col(supported) == "yes") & ~F.col(self_answering)
    for f in flags:
        out = out & F.col(f)
    return false_if_null(out)


def likely_ambiguous(bm25_rank: Column, dense_rank: Column, beyond: int = 10) -> Column:
    """Neither ranking finds the page; where the dense one is unknown, no."""
    return false_if_null((bm25_rank > beyond) & (dense_rank > beyond))


def rule_flags(items: DataFrame, pages: DataFrame, least_chars: int = 400) -> DataFrame:
    """items (page_id, n, question, query, facts) of pages (page_id, title, text) with flags, an array in rule order.

    dup: word Jaccard of 0.8 with an earlier item of the page; query_leak; fact_unmatched; no_anchor: shares neither a
    stem nor a word with the title; padded: several items and under 400 characters of text for each. Language checks
    need a detector and are a plug-in.
    """
    title = F.regexp_replace(F.col("title"), r"\(.*?\)", "")
    p = pages.select(
        "page_id", T.stems(F.col("text")).alias("text_stems"), T.numbers_in(F.col("text")).alias("text_numbers"), F.length("text").alias("chars"),
        F.when(F.size(T.stems(title)) > 0, T.stems(title)).otherwise(F.array_distinct(T.words(F.col("title")))).alias("title_words"),
    )
    of = items.groupBy("page_id").agg(F.count(F.lit(1)).alias("of"))
    checks = {
        "query_leak": T.number_leak(F.col("query"), F.col("facts"), F.col("question")),
        "fact_unmatched": ~F.forall("facts", lambda f: T.fact_ok(f, F.col("text_stems"), F.col("text_numbers"))),
        "no_anchor": ~F.arrays_overlap("title_words", F.array_union(T.stems(F.col("question")), F.array_distinct(T.words(F.col("question"))))),
        "padded": (F.col("of") > 1) & (F.col("chars") / F.col("of") < least_chars),
    }
    # A page's words lie beside each of its items here: only what is checked goes on to a shuffle.
    checked = items.join(p.join(of, "page_id"), "page_id").select("page_id", "n", *(false_if_null(c).alias(name) for name, c in checks.items()))
    repeats = near_repeats(items).withColumn("dup", F.lit(True))
    i = checked.join(repeats, ["page_id", "n"], "left")
    flags = F.array_compact(F.array(*(F.when(F.col(name), F.lit(name)) for name in ("dup", *checks))))
    return i.select("page_id", "n", flags.alias("flags"))


def near_repeats(items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(page_id, n) of items whose words have that Jaccard with an earlier item of the page."""
    return earlier_similar(items.select("page_id", "n", T.words(F.col("question")).alias("words")), "page_id", "n", "words", threshold)


def repeated_across_pages(items: DataFrame) -> DataFrame:
    """(question_norm, pages) of normalised questions that occur on more than one page."""
    found = items.groupBy(T.question_norm(F.col("question")).alias("question_norm")).agg(F.countDistinct("page_id").alias("pages"))
    return found.where("pages > 1")


def repaired(items: DataFrame, repairs: DataFrame, relabels: DataFrame) -> DataFrame:
    """items (page_id, j, question) with a repair's question where one exists and its relabel's verdict is keep."""
    fixes = repairs.select("page_id", "j", F.col("question").alias("fixed")).join(relabels.where("verdict = 'keep'").select("page_id", "j"), ["page_id", "j"])
    return items.join(fixes, ["page_id", "j"], "left").select("page_id", "j", F.coalesce("fixed", "question").alias("question"), F.col("fixed").isNotNull().alias("repaired"))


def current_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers whose question still reads as it did when they were written."""
    return answers.join(questions.select("page_id", "kind", "src_j", F.col("question").alias("q")), ["page_id", "kind", "src_j"]).where("q = question").drop("q")


def judged_ok(judgements: DataFrame, keys: Sequence[str], criteria: Sequence[str], apart: str = "x_ok") -> DataFrame:
    """One row a key: each criterion true if all present judges say so, answer_ok over all but `apart`, which is null unless both of two judged; judges counts them."""
    each = [F.bool_and(c).alias(c) for c in criteria]
    rows = judgements.groupBy(*keys).agg(F.count(F.lit(1)).alias("judges"), *each)
    ok = F.lit(True)
    for c in criteria:
        if c != apart:
            ok = ok & F.col(c)
    return rows.withColumn("answer_ok", ok).withColumn(apart, F.when(F.col("judges") == 2, F.col(apart)))


def unanswerable_ok(checks: Sequence[str], judged: str, answering: str) -> Column:
    """All checks pass, it has been judged, and no page answers it."""
    out = F.col(judged) & (F.size(answering) == 0)
    for c in checks:
        out = out & F.col(c)
    return false_if_null(out)


def label_errors(items: DataFrame) -> DataFrame:
    """(page_id, j, errors) of labelled items (page_id, j, question, the labels, verdict) that contradict each other or the texts."""
    earlier = F.row_number().over(Window.partitionBy("page_id", T.question_norm(F.col("question"))).orderBy("j")) > 1
    flags = [F.when(F.col(c), F.lit(c)) for c in NEGATIVE_LABELS] + [F.when(~F.col(c), F.lit(c)) for c in POSITIVE_LABELS if c in items.columns]
    flags.append(F.when(F.col("facts_supported") != "yes", F.lit("facts_supported")))
    found = F.array_compact(F.array(*flags))
    rows = items.withColumns({"repeats": earlier, "raised": found})
    errors = F.array_compact(
        F.array(
            F.when(F.col("repeats") & ~F.col("duplicate"), F.lit("repeated text must be duplicate")),
            F.when((F.col("verdict") == "keep") & (F.size("raised") > 0), F.concat(F.lit("keep contradicts "), F.array_join("raised", ","))),
            F.when((F.col("verdict") != "drop") & (F.col("duplicate") | (F.col("facts_supported") == "no")), F.lit("must be drop")),
        )
    )
    return rows.select("page_id", "j", errors.alias("errors")).where(F.size("errors") > 0)


def label_problems(items: DataFrame, flags: Sequence[str]) -> DataFrame:
    """(page_id, j, problems): the names of unset flags, and 'unsupported facts' where they aren't supported."""
    parts = [F.when(~F.col(f), F.lit(f)) for f in flags] + [F.when(F.col("facts_supported") != "yes", F.lit("unsupported facts"))]
    return items.select("page_id", "j", F.array_compact(F.array(*parts)).alias("problems"))


def qrel_rollup(candidates: DataFrame) -> DataFrame:
    """One row for each question of pooled judgements (question_id, own_id, id, match yes|partly|no, answers, bm25_rank)."""
    other = F.col("id") != F.col("own_id")
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("id"))))
    hard = F.collect_list(F.when(other & (F.col("match") == "no") & F.col("bm25_rank").isNotNull(), F.struct("bm25_rank", "id")))
    rows = candidates.groupBy("question_id").agg(
        F.max(F.when(~other, F.col("match"))).alias("gold_match"), F.max(F.when(~other, F.col("answers"))).alias("gold_answers"), ids(other & (F.col("match") == "yes")).alias("relevant"), ids(other & (F.col("match") == "partly")).alias("partial"),
        ids(F.col("answers")).alias("answering"), F.transform(F.slice(F.array_sort(hard), 1, 10), lambda x: x["id"]).alias("hard_negatives"),
        (1 + F.count_if(other & (F.col("match") == "yes"))).alias("n_relevant"), (F.count_if(other & (F.col("match") != "no")) >= 10).alias("pool_saturated"),
    )
    return rows.withColumn("hits", F.when(F.col("n_relevant") == 1, "unique").when(F.col("n_relevant") <= 3, "few").otherwise("many"))


def candidate_pool(sparse: DataFrame, same_item: DataFrame, gold: DataFrame, most_sparse: int = 20, most_same: int = 6) -> DataFrame:
    """(question_id, id), distinct: the best of a ranking, a few pages of the same item, and the gold page."""
    same = same_item.withColumn("nth", F.row_number().over(Window.partitionBy("question_id").orderBy("id"))).where(F.col("nth") <= most_same)
    ranked = sparse.where(F.col("rank") <= most_sparse).select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("id"))
    return ranked.unionByName(same.select("question_id", "id")).unionByName(gold.select("question_id", "id")).distinct()


def list_specs(items: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(category, country, n, ids) of groups of so many items; items (id, country, categories)."""
    rows = items.select("id", "country", F.explode(F.array_distinct("categories")).alias("category"))
    groups = rows.groupBy("category", "country").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    return rows.join(groups, ["category", "country"]).groupBy("category", "country", "n").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def pages_with_items(pages: DataFrame, layer: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """pages (id, ...) that have generated items, with the items and the model that made them; only pages of ids, if given. Layer rows with an error don't count."""
    wanted = pages if ids is None else pages.join(ids.select("id").distinct(), "id", "left_semi")
    return wanted.join(layer.where("items is not null and error is null").select("id", "items", F.col("model").alias("gen_model")), "id")


def partners(items: DataFrame) -> DataFrame:
    """(id, partner): a page of another item of the same language, country and a shared category, the least by the hash of both ids; without one no row.

    items (id, lang, country, categories[, item]); without the last an id is its own item. No pairs are made.
    """
    item = F.col("item") if "item" in items.columns else F.col("id")
    rows = items.select("id", item.alias("item"), "lang", "country", F.explode(F.array_distinct("categories")).alias("category"))
    return least_hash_partner(rows, ["lang", "country", "category"])


def merged_places(rows: DataFrame) -> DataFrame:
    """One row an item: all categories in first-seen order; the row of the first country seen, in its best-ranked language.

    rows (item, category, country, lang, lang_pos, pos). lang_pos is the language's place in the country's list; rows
    in other languages (null) only add a category to an item that has a row.
    """
    first = rows.where("lang_pos is not null").groupBy("item").agg(F.min_by(F.struct("country", "pos"), "pos").alias("f"))
    known = rows.join(first, "item").where(F.col("pos") >= F.col("f.pos"))
    best = F.min_by(F.struct("lang", "country"), F.when((F.col("country") == F.col("f.country")) & F.col("lang_pos").isNotNull(), F.struct("lang_pos", "pos")))
    seen = known.groupBy("item", "category").agg(F.min("pos").alias("at"))
    categories = seen.groupBy("item").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "category"))), lambda x: x["category"]).alias("categories"))
    return known.groupBy("item").agg(best.alias("b")).join(categories, "item").select("item", "b.lang", "b.country", "categories")


def first_attributes(pages: DataFrame, item: str, order: str, attributes: Sequence[str]) -> DataFrame:
    """One row an item: the attributes of its first page, and all its pages in order."""
    return pages.groupBy(item).agg(F.min_by(F.struct(*attributes), order).alias("x"), F.transform(F.array_sort(F.collect_list(F.struct(order, "page_id"))), lambda s: s["page_id"]).alias("pages")).select(item, "x.*", "pages")


def array_aggregate(values: str, labels: str, op: Column, exclude: str | None = None) -> Column:
    """struct<value, label> over an array of numbers with nulls: max, min, mean, sum, count, argmax, argmin; excluded positions and nulls are left out, under two values gives null; the first of equals wins; two digits, ties to even."""
    zipped = F.transform(F.col(values), lambda v, i: F.struct(v.cast("double").alias("v"), F.get(F.col(labels), i).alias("l"), i.alias("i")))
    kept = F.filter(zipped, lambda x: x["v"].isNotNull() & ~F.array_contains(F.col(exclude), x["i"])) if exclude else F.filter(zipped, lambda x: x["v"].isNotNull())
    v = F.transform(kept, lambda x: x["v"])
    total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    high, low = F.array_max(v), F.array_min(v)
    where = lambda best: F.get(F.filter(kept, lambda x: x["v"] == best), F.lit(0))["l"]
    value = F.when(op.isin("max", "argmax"), high).when(op.isin("min", "argmin"), low).when(op == "mean", total / F.nullif(F.size(v), F.lit(0))).when(op == "sum", total).when(op == "count", F.size(v).cast("double"))
    value = F.when(op.isin("argmax", "argmin"), value).otherwise(F.bround(value, 2))
    label = F.when(op == "argmax", where(high)).when(op == "argmin", where(low))
    return F.when(F.size(v) >= 2, F.struct(value.alias("value"), label.alias("label")))


def balanced_subset(rows: DataFrame, group: str, key: str, most: int = 400) -> DataFrame:
    """The first `most` distinct keys of each group by their hash."""
    w = Window.partitionBy(group).orderBy(crc(F.col(key)), F.col(key))
    return rows.select(group, key).distinct().withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)


def round_robin(rows: DataFrame, group: str, key: str) -> DataFrame:
    """rows with turn, the place within their group: the groups take turns, each in the order of its keys' hashes. Order by (turn, group) to walk them."""
    hashed = rows.withColumn("__hash", crc(F.col(key)))
    found = placed(hashed, [group, "__hash", key], "round-robin")
    first = found.groupBy(F.col(group).alias("__group")).agg(F.min("place").alias("__first"))
    joined = found.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return joined.select(*rows.columns, (F.col("place") - F.col("__first") + 1).cast("int").alias("turn"))


def other_language(options: Sequence[str], own: Column, key: Column) -> Column:
    """One of the options but the own language, by the key's hash."""
    others = F.filter(F.array(*map(F.lit, options)), lambda x: x != own)
    return pick(others, key)


def item_context(items: DataFrame, pages: DataFrame, most_chars: int = 6_000) -> DataFrame:
    """(page_id, j, question, others, article): the page's other questions, one a line or '(none)', and the start of the article."""
    every = items.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("j", "question"))).alias("all"))
    joined = items.join(every, "page_id").join(pages.select("page_id", F.left("text", F.lit(most_chars)).alias("article")), "page_id")
    others = F.array_join(F.transform(F.filter("all", lambda x: x["j"] != F.col("j")), lambda x: x["question"]), "\n")
    return joined.select("page_id", "j", "question", F.when(others == "", F.lit("(none)")).otherwise(others).alias("others"), "article")


def complete_replies(replies: DataFrame) -> DataFrame:
    """(request_id, ok): the returned positions are exactly 0 to n - 1. replies (request_id, n, js array)."""
    return replies.select("request_id", F.when(F.col("n") > 0, F.coalesce(F.array_sort("js") == F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), F.lit(False))).otherwise(F.size("js") == 0).alias("ok"))


def refreshed_ranks(old: DataFrame, bm25: DataFrame, dense_since: Column) -> DataFrame:
    """(id, bm25_rank, dense_rank, margin): BM25 ranks anew, the dense part only where the row is older than the last dense run."""
    joined = old.join(bm25, "id", "left")
    fresh = F.col("created_at") < dense_since
    return joined.select("id", "bm25_rank", F.when(fresh, F.col("dense_rank")).alias("dense_rank"), F.when(fresh, F.col("margin")).alias("margin"))


def excerpts(pages: DataFrame, queries: DataFrame, df: DataFrame, n_docs: Column, lead: int = 700, most: int = 6, most_chars: int = 400) -> DataFrame:
    """(query_id, excerpt sentences): of the sentences after the lead the six with most idf weight shared with the question, in document order."""
    asked = queries.select("query_id", "page_id", F.explode(T.prefixes(F.col("question"))).alias("p")).join(df, "p", "left").select("query_id", "page_id", "p", F.log(n_docs / F.coalesce("df", F.lit(1))).alias("w"))
    s = pages.select("page_id", F.posexplode(T.excerpt_sentences(F.col("text"), lead)).alias("pos", "sentence"))
    words_of = s.select("page_id", "pos", F.explode(T.prefixes(F.col("sentence"))).alias("p"))
    value = asked.join(words_of, ["page_id", "p"]).groupBy("query_id", "page_id", "pos").agg(F.round(F.sum("w"), 9).alias("value"))
    best = value.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("value"), "pos"))).where(F.col("nth") <= most)
    return best.join(s, ["page_id", "pos"]).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.left("sentence", F.lit(most_chars)).alias("s")))), lambda x: x["s"]).alias("sentences"))
