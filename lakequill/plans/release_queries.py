"""Driver queries of the release build, evaluation filters and small store rules; stand-ins as in build_queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions import vectors
from lakequill.operators import dense, evaluation, geo, qa, quotes, store, web
from lakequill.plans import release
from lakequill.plans.build_queries import CRC, CRC_TABLE
from lakequill.plans.registry import query

NORM = r"trim(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


@query("SELECT doc_id AS question_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality = 1 AND doc_id % 3 > 0 AND lang = 'en'")
def eval_questions(t) -> DataFrame:
    rows = t("documents").join(t("labels"), "doc_id", "left")
    rows = rows.select(F.col("doc_id").alias("question_id"), (F.col("quality") == 1).alias("answer_ok"), F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("test").alias("split"), F.col("lang").alias("qtype"))
    return evaluation.eval_questions(rows, "en").select("question_id")


@query(
    """SELECT conv_id AS page_id, turn AS j, CASE WHEN turn % 7 = 3 THEN 'missing' WHEN turn % 4 = 1 THEN 'facts' END AS problem FROM conversations WHERE turn % 7 = 3 OR turn % 4 = 1
    UNION ALL SELECT conv_id, turn + 500, 'unexpected' FROM conversations WHERE turn = 0"""
)
def batch_problems(t) -> DataFrame:
    c = t("conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("j"))
    facts = F.array_repeat(F.lit("f"), F.when(F.col("j") % 4 == 1, F.when(F.col("j") % 8 == 1, 0).otherwise(4)).otherwise(F.lit(1) + (F.col("j") % 3).cast("int")))
    return release.batch_problems(c.withColumn("facts", facts), c.where("j % 7 <> 3").unionByName(c.where("j = 0").withColumn("j", F.col("j") + 500)))


@query(r"SELECT conv_id, turn, 'the ' || lower(role) || ' of ' || conv_id AS key FROM conversations")
def place_keys(t) -> DataFrame:
    name = F.concat(F.lit("  The\t"), F.initcap("role"), F.lit("  OF \n"), F.col("conv_id").cast("string"), F.lit(" "))
    return t("conversations").select("conv_id", "turn", T.place_key(name).alias("key"))


@query("SELECT s_suppkey AS query_id, s_suppkey * 10 + 2 AS place_id FROM supplier")
def named_places(t) -> DataFrame:
    """Hits of a name: another label, then a person, then one without a point, then the place; of the last two the fourth and the fifth fit, the sixth is too late."""
    named = t("supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Old Town "), F.col("s_suppkey").cast("string")).alias("place"))
    hit = lambda i, label, lat, person: F.struct(F.lit(i).alias("position"), (F.col("query_id") * 10 + {1: 0, 2: 1, 3: 9, 4: 2, 5: 3, 6: 4}[i]).alias("place_id"), F.lit(label).alias("label"), F.lit(lat).cast("double").alias("lat"), F.lit(14.0).alias("lon"), F.lit(person).alias("is_person"))
    hits = F.array(hit(1, "Somewhere", 45.0, False), hit(2, "Mr Town", 45.0, True), hit(3, "town hall", None, False), hit(4, "TOWN, old", 45.0, None), hit(5, "Old", 45.0, False), hit(6, "Old Town", 45.0, False))
    return geo.resolve(named, named.select("place", "query_id", F.explode(hits).alias("h")).select("place", "h.*")).select("query_id", "place_id")


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(substr(text, 701), '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(x) > 20), chr(1)) AS sentences FROM documents")
def excerpt_sentences(t) -> DataFrame:
    return t("documents").select("doc_id", F.array_join(T.excerpt_sentences(F.col("text")), "\u0001").alias("sentences"))


@query(
    r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '  | a' ELSE 'a |' END || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ' |' ELSE '' END || replace(text, chr(10), ' ') AS body, doc_id % 3 = 0 AS inside FROM documents WHERE length(text) > 60)
    SELECT doc_id, round_even((CASE WHEN doc_id % 2 = 0 THEN 6 ELSE 4 END + CASE WHEN inside THEN 2 ELSE 0 END + 20) / length(body)::DOUBLE, 3) AS position, inside AS in_table FROM d"""
)
def evidence_positions(t) -> DataFrame:
    lead = F.concat(F.when(F.col("doc_id") % 2 == 0, "  | a").otherwise("a |"), F.lit("\n"), F.when(F.col("doc_id") % 3 == 0, " |").otherwise(""))
    d = t("documents").where(F.length("text") > 60).select("doc_id", F.concat(lead, F.replace("text", F.lit("\n"), F.lit(" "))).alias("body"), (F.length(lead) + 20).cast("long").alias("at"))
    span = F.array(F.col("at"), F.col("at") + 5)
    return d.select("doc_id", quotes.evidence_position(F.col("body"), span).alias("position"), quotes.in_table(F.col("body"), span).alias("in_table"))


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 10 = 3")
def chunks_not_ready(t) -> DataFrame:
    e = t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    nan = F.transform("vec", lambda x: F.lit(float("nan")).cast("float"))
    have = e.where("chunk_id % 9 <> 0").withColumn("vec", F.when(F.col("chunk_id") % 10 == 3, nan).otherwise(F.col("vec")))
    return dense.not_ready(e.select("chunk_id"), have)


@query(r"""WITH x AS (SELECT 'https://example.org/' || page_id AS url, 'Words ' || page_id || ' stand here, in an article that says so.' AS text FROM pages) SELECT url, sha256(text) AS sha256, length(text) AS char_count, 'prose' AS kind, 'sl' AS language FROM x""")
def page_metadata(t) -> DataFrame:
    text = F.concat(F.lit("Words "), F.col("page_id").cast("string"), F.lit(" stand here, in an article that says so."))
    pages = t("pages").select(F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("url"), F.concat(F.lit('<html lang="sl-SI"><body><nav><a href="/">Home</a></nav><article><p>'), text, F.lit("</p></article></body></html>")).alias("html"))
    return web.extract_pages(pages).select("url", "sha256", "char_count", "kind", "language")


@query(
    f"""WITH q AS (SELECT source AS page_id, doc_id AS j, {NORM.format('text')} AS norm FROM documents), r AS (SELECT norm FROM q GROUP BY 1 HAVING count(DISTINCT page_id) > 1)
    SELECT doc_id AS j, {NORM.format('text')} IN (SELECT norm FROM r) OR doc_id % 50 = 7 AS ambiguous FROM documents"""
)
def ambiguous_questions(t) -> DataFrame:
    d = t("documents")
    questions = d.select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("page_id"), F.col("doc_id").alias("j"), F.col("text").alias("question"))
    near = d.where("doc_id % 25 = 7").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("doc_id") % 50 == 7, 0.98).otherwise(0.97999).alias("similarity"))
    return release.ambiguous(questions, near).select("j", F.col("ambiguous_across_pages").alias("ambiguous"))


@query(
    """SELECT doc_id AS page_id, 'corpus' AS kind, 0::BIGINT AS src_j FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 > 0 UNION ALL SELECT doc_id, 'challenge', 1 FROM labels WHERE quality = 1 AND coalesce(toxic, 1) = 0"""
)
def kept_items(t) -> DataFrame:
    corpus = t("documents").select(F.col("doc_id").alias("page_id"), F.lit(0).cast("long").alias("j"), F.col("text").alias("question"), F.when(F.col("doc_id") % 3 == 0, "keep").otherwise("drop").alias("verdict"), (F.col("doc_id") % 4 == 0).alias("ambiguous_across_pages"))
    challenge = t("labels").select(F.col("doc_id").alias("page_id"), F.lit(1).cast("long").alias("j"), F.lit("q").alias("question"), (F.col("quality") == 1).alias("challenge_ok"), (F.coalesce("toxic", F.lit(1)) == 1).alias("likely_ambiguous"))
    return release.kept_items(corpus, challenge).select("page_id", "kind", "src_j")


@query("SELECT conv_id AS page_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS j, text AS item FROM conversations WHERE conv_id % 4 > 0 QUALIFY turn % 3 > 0 AND turn % 5 > 0")
def items_with_all_criteria(t) -> DataFrame:
    """Pages whose judge left out an item don't count, nor items with a criterion that is off or unknown."""
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    labels = F.transform("x", lambda i: F.struct((i["turn"] % 3 > 0).alias("grounded"), F.when(i["turn"] % 5 > 0, F.lit(True)).alias("complete")))
    rows = c.select(F.col("conv_id").alias("page_id"), F.transform("x", lambda i: i["text"]).alias("items"), F.when(F.col("conv_id") % 4 == 0, F.slice(labels, 1, F.size("x") - 1)).otherwise(labels).alias("labels"))
    return release.all_criteria(rows, "labels", ["grounded", "complete"])


@query(
    f"""WITH {CRC_TABLE}, b AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {CRC.format('doc_id::VARCHAR')}, doc_id) AS nth FROM documents, t) WHERE nth <= 50),
    u AS (SELECT doc_id, 'hard' AS question FROM labels WHERE quality = 1 UNION SELECT doc_id, 'plain' FROM b UNION SELECT doc_id, 'none' FROM labels WHERE toxic = 1)
    SELECT doc_id AS page_id, question, CASE WHEN doc_id IN (SELECT doc_id FROM b) THEN 0 ELSE 1 END AS tier FROM u"""
)
def qrel_jobs(t) -> DataFrame:
    of = lambda rows, q: rows.select(F.col("doc_id").alias("page_id"), F.lit(q).alias("question"))
    unanswerable = t("labels").select(F.col("doc_id").alias("page_id"), F.lit("none").alias("question"), (F.col("toxic") == 1).alias("ok"))
    return release.qrel_jobs(of(t("labels").where("quality = 1"), "hard"), of(t("documents"), "plain").join(t("documents").select(F.col("doc_id").alias("page_id"), "lang"), "page_id"), unanswerable, 50)


@query("SELECT 'q|' || conv_id || '|' || turn AS key, conv_id AS page_id, text AS question FROM conversations UNION ALL SELECT 'c|' || doc_id || '|0', doc_id, lang FROM documents")
def keyed_questions(t) -> DataFrame:
    q = t("conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("j"), F.col("text").alias("question"))
    return release.keyed_questions(("q", q), ("c", t("documents").select(F.col("doc_id").alias("page_id"), F.lit(0).cast("long").alias("j"), F.col("lang").alias("question"))))


@query("SELECT page_id, page_id % 3 <> 0 AS html FROM pages")
def html_types(t) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, "application/xhtml+xml").otherwise("text/plain; note=html")).otherwise("Text/HTML; charset=utf-8")
    return t("pages").select("page_id", T.is_html(kind).alias("html"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 3 = 0 THEN 'note ' || doc_id ELSE lang END AS role FROM documents")
def filled_notes(t) -> DataFrame:
    rows = t("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("role"))
    gone = rows.select((F.col("id") + 10_000_000).alias("id"), F.lit("gone").alias("text"))
    notes = rows.where("id % 3 = 0 or id % 10 = 0").select("id", F.when(F.col("id") % 10 == 0, "").otherwise(F.concat(F.lit("note "), F.col("id").cast("string"))).alias("text"))
    return store.filled(rows, notes.unionByName(gone), "role")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 2 = 0")
def done_everywhere(t) -> DataFrame:
    ids = lambda rows: rows.select(F.col("doc_id").alias("id"))
    return store.done_everywhere([ids(t("documents").where("doc_id % 2 = 0")), ids(t("labels")), ids(t("labels").where("quality = 1"))])


@query("SELECT d.doc_id AS id, lang, quality AS items, 'm' || toxic AS gen_model FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 0 AND quality IS NOT NULL AND lang <> 'fr'")
def pages_with_items(t) -> DataFrame:
    pages = t("documents").select(F.col("doc_id").alias("id"), "lang")
    layer = t("labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("items"), F.concat(F.lit("m"), F.col("toxic").cast("string")).alias("model"), F.when(F.col("toxic") != 0, "bad").alias("error"))
    return qa.pages_with_items(pages, layer, pages.where("lang <> 'fr'").unionByName(pages.where("lang = 'en'")))


@query(
    """WITH n AS (SELECT l_orderkey, count(*) AS rows FROM lineitem GROUP BY 1) SELECT o_orderpriority AS language, count(*) FILTER (rows >= 4) AS pages, coalesce(sum(CASE WHEN rows >= 4 THEN 2 ELSE 0 END), 0)::BIGINT AS tables
    FROM orders JOIN n ON o_orderkey = l_orderkey GROUP BY 1"""
)
def table_census(t) -> DataFrame:
    """Pages of two tables with a row for each line of an order: four rows make a table."""
    line = F.concat_ws(" | ", F.lit("|"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string"), F.lit("|"))
    body = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    table = F.concat(F.lit("| line | quantity |\n|---|---|\n"), F.regexp_replace("body", r"(?m)^\| \| | \| \|$", "|"))
    pages = t("orders").join(body, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderpriority").alias("language"), F.concat(F.lit("Before.\n"), table, F.lit("\nBetween.\n"), table).alias("text"))
    return quotes.table_census(pages)


@query("SELECT vec_id, round(sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])) / sqrt(list_dot_product(embedding[1:16]::DOUBLE[], embedding[1:16]::DOUBLE[])), 6) AS norm FROM embeddings")
def shortened_norms(t) -> DataFrame:
    return t("embeddings").select("vec_id", F.round(vectors.norm(vectors.shortened(F.col("embedding"), 16)), 6).alias("norm"))
