"""Driver queries of the retrieval operators: documents are the corpus, benchmark passages the queries, embeddings the vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.functions import text as T
from lakequill.functions.ids import stable_order
from lakequill.operators import dense, evaluation, geo, ranking, segments, sparse, store
from lakequill.operators.chunking import chunk_pages
from lakequill.operators.sizes import spread
from lakequill.plans.registry import query

TOK = r"""
  tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents),
  len AS (SELECT id, greatest(len(ts), 1) AS l FROM tok),
  c AS (SELECT count(*) AS n, avg(l) AS a FROM len),
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ts) AS term FROM tok) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""
BM25 = TOK + r""",
  w AS (SELECT tf.term, tf.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a)) AS w
        FROM tf JOIN df USING (term) JOIN len USING (id), c),
  q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
  s AS (SELECT qid, id, sum(qtf * w) AS score FROM q JOIN w USING (term) GROUP BY ALL),
  sparse AS (SELECT * FROM (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 100)"""
QRELS = r"""
  rel AS (SELECT item_id AS qid, doc_id AS id FROM benchmark b, documents d
          WHERE contains(trim(regexp_replace(d.text, '\s+', ' ', 'g')), trim(regexp_replace(b.text, '\s+', ' ', 'g'))))"""
VEC = r"""
  v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
  vq AS (SELECT * FROM v WHERE id % 20 = 0),
  ds AS (SELECT vq.id AS qid, v.id, list_dot_product(vq.e, v.e) AS score FROM vq, v),
  dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM ds) WHERE rank <= 30)"""


def corpus(t) -> DataFrame:
    return spread(t("documents").select(F.col("doc_id").alias("id"), "text"))


def asked(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label")


def vector_queries(t) -> DataFrame:
    return vectors(t).where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")


def bm25_ranking(t, limit: int = 10) -> DataFrame:
    return sparse.bm25(asked(t), corpus(t), limit)


def qrels(t) -> DataFrame:
    return evaluation.passages_in(t("benchmark"), corpus(t))


def r6(c: Column) -> Column:
    return F.round(c, 6)


@query(f"WITH {TOK} SELECT id, term, tf FROM tf")
def token_counts(t) -> DataFrame:
    return sparse.term_counts(corpus(t))


@query(f"WITH {TOK} SELECT id, l AS length FROM len")
def doc_lengths(t) -> DataFrame:
    return sparse.doc_lengths(corpus(t))


@query(f"WITH {TOK} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, c")
def doc_freq_idf(t) -> DataFrame:
    df = sparse.term_counts(corpus(t)).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(sparse.corpus_size(corpus(t)))).select("term", "df", r6(sparse.idf(F.col("n"), F.col("df"))).alias("idf"))


@query(f"WITH {BM25} SELECT term, id AS chunk_id, round(w, 6) AS w FROM w WHERE term IN (SELECT term FROM q)")
def bm25_weights(t) -> DataFrame:
    return sparse.postings(corpus(t), sparse.query_terms(asked(t))).withColumn("w", r6(F.col("w")))


@query(f"WITH {BM25} SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM sparse WHERE rank <= 10 AND score > 0")
def bm25_topk(t) -> DataFrame:
    return bm25_ranking(t).withColumn("score", r6(F.col("score")))


@query(f"WITH {BM25} SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM sparse WHERE rank <= 10 AND score > 0")
def bm25_indexed_topk(t) -> DataFrame:
    """The index is written, texts of one language first and the others added to it, then asked."""
    return segments.search(asked(t), stored_index(t)).withColumn("score", r6(F.col("score")))


def stored_index(t) -> segments.Index:
    docs, english = t("documents"), F.coalesce(F.col("lang") == "en", F.lit(False))
    path = store.fresh_path(docs.sparkSession, "bm25-index")
    for part in (docs.where(english), docs.where(~english)):
        segments.add_segments(spread(part.select(F.col("doc_id").alias("id"), "text")), path)
    return segments.Index(docs.sparkSession, path)


@query(
    f"""WITH {BM25}, {QRELS}, own AS (SELECT qid, min(id) AS own_id FROM rel GROUP BY 1)
    SELECT own.qid AS query_id, coalesce(rank, 101) AS bm25_rank FROM own LEFT JOIN sparse ON own.qid = sparse.qid AND own_id = id"""
)
def bm25_rank_of_own_doc(t) -> DataFrame:
    own = qrels(t).groupBy(F.col("question_id").alias("query_id")).agg(F.min("chunk_id").alias("own_id"))
    return sparse.own_rank(asked(t).join(own, "query_id"), corpus(t))


@query(
    r"""WITH p AS (SELECT doc_id AS id, ts[i] AS term, i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM documents), unnest(range(1, len(ts) + 1)) AS u(i)),
    tf AS (SELECT id, term, count(*) AS tf, min(i) AS first FROM p GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) < 200),
    s AS (SELECT id, term, first, round(ln((SELECT count(*) FROM documents) / df::DOUBLE) * ln(1 + tf), 9) AS value FROM tf JOIN df USING (term) WHERE length(term) > 2 AND NOT regexp_full_match(term, '\p{N}+')),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, first) AS rank FROM s)
    SELECT id, rank, term, round(value, 6) AS value FROM r WHERE rank <= 25"""
)
def distinctive_terms(t) -> DataFrame:
    return sparse.distinctive_terms(corpus(t)).withColumn("value", r6(F.col("value")))


@query(
    f"""WITH {QRELS}, own AS (SELECT qid, min(id) AS id FROM rel GROUP BY 1),
    """
    + r"""wd AS (SELECT doc_id AS id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM documents),
    df AS (SELECT term, count(*) AS df FROM (SELECT unnest(ws) AS term FROM wd) GROUP BY 1),
    bq AS (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ts FROM benchmark),
    q AS (SELECT qid, own.id, ts[i] AS term, i FROM bq JOIN own USING (qid), unnest(range(1, len(ts) + 1)) AS u(i)),
    w AS (SELECT qid, id, left(term, 5) AS b, arg_max(ln((SELECT count(*) FROM documents) / coalesce(df, 1)::DOUBLE), i) AS w FROM q LEFT JOIN df USING (term) GROUP BY ALL),
    pre AS (SELECT DISTINCT id, left(w, 5) AS b FROM (SELECT id, unnest(ws) AS w FROM wd))
    SELECT w.qid AS query_id, round_even(sum(CASE WHEN pre.b IS NOT NULL THEN w ELSE 0 END) / nullif(sum(w), 0), 3) AS lex_overlap
    FROM w LEFT JOIN pre ON w.id = pre.id AND w.b = pre.b GROUP BY 1"""
)
def lex_overlap(t) -> DataFrame:
    own = qrels(t).groupBy(F.col("question_id").alias("query_id")).agg(F.min("chunk_id").alias("id"))
    return sparse.lex_overlap(asked(t).join(own, "query_id").select("query_id", F.col("text").alias("question"), "id"), corpus(t))


@query(f"WITH {VEC} SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM dense WHERE rank <= 10")
def dense_topk(t) -> DataFrame:
    return dense.dense_top_k(vector_queries(t).select("query_id", "vec"), vectors(t).select("chunk_id", "vec"), 10).withColumn("score", r6(F.col("score")))


@query(
    f"""WITH {VEC}, o AS (SELECT qid, (qid + 1) % (SELECT count(*) FROM v) AS own FROM (SELECT DISTINCT qid FROM ds)),
    b AS (SELECT o.qid, o.own, round(score, 9) AS own_score FROM o JOIN ds ON ds.qid = o.qid AND ds.id = o.own)
    SELECT b.qid AS query_id, 1 + count(*) FILTER (round(score, 9) > own_score AND ds.id <> own) AS dense_rank,
           round(max(own_score) - max(round(score, 9)) FILTER (ds.id <> own), 4) AS margin FROM b JOIN ds ON ds.qid = b.qid GROUP BY 1"""
)
def dense_rank_margin(t) -> DataFrame:
    n = F.lit(vectors(t).count())
    return dense.own_rank_margin(vector_queries(t).select("query_id", "vec", ((F.col("query_id") + 1) % n).alias("own_id")), vectors(t).select("chunk_id", "vec"))


_CENTRED = r"""
  u AS (SELECT vec_id AS id, label, list_transform(embedding[1:48]::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding[1:48]::DOUBLE[], embedding[1:48]::DOUBLE[]))) AS e FROM embeddings),
  m AS (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(e[i]) AS x FROM u, unnest(range(1, 49)) AS r(i) GROUP BY i)),
  k AS (SELECT id, label, list_transform(range(1, 49), lambda i: e[i] - m[i]) AS e FROM u, m),
  n AS (SELECT id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM k),
  nn AS (SELECT a.id, arg_min(b.id, (-round(list_dot_product(a.e, b.e), 6), b.id)) AS other_id, max(round(list_dot_product(a.e, b.e), 6)) AS similarity FROM n a, n b WHERE a.label <> b.label GROUP BY 1)"""


def _nearest(t) -> DataFrame:
    moved = dense.centred(vectors(t), 48)
    found = dense.nearest_other(moved.withColumn("vec", F.col("vec").cast("array<float>")), "label")
    return found.select(F.col("chunk_id").alias("id"), F.round("similarity", 3).alias("similarity"))


@query(f"WITH {_CENTRED} SELECT id, round(similarity, 3) AS similarity FROM nn")
def knn_other_group(t) -> DataFrame:
    return _nearest(t)


@query(f"WITH {_CENTRED} SELECT band::DOUBLE AS band, round(avg((similarity >= band)::INT), 6) AS share FROM nn, (VALUES (0.8), (0.85), (0.9), (0.95), (0.98)) AS b(band) GROUP BY 1")
def similarity_bands(t) -> DataFrame:
    return dense.similarity_bands(_nearest(t)).withColumn("share", r6(F.col("share")))


@query(f"WITH {VEC} SELECT a.id AS chunk_id, round(max(list_dot_product(a.e, b.e)), 3) AS template_sim FROM v a JOIN v b ON a.id <> b.id GROUP BY 1")
def template_similarity(t) -> DataFrame:
    v = vectors(t).select("chunk_id", "vec")
    found = dense.dense_top_k(v.withColumn("group", F.col("chunk_id")).select(F.col("chunk_id").alias("query_id"), "vec", "group"), v.withColumn("group", F.col("chunk_id")), 1, "group")
    return found.select(F.col("query_id").alias("chunk_id"), F.round("score", 3).alias("template_sim"))


_LEGS = f"""WITH {BM25},
  leg1 AS (SELECT qid, id, rank, score FROM sparse WHERE rank <= 30 AND score > 0),
  ov AS (SELECT leg1.qid, leg1.id, leg1.rank, len(list_intersect(list_distinct(qt.ts), tok.ts))::DOUBLE / greatest(len(list_distinct(qt.ts)), 1) AS o FROM leg1 JOIN tok USING (id)
         JOIN (SELECT item_id AS qid, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ts FROM benchmark) qt USING (qid)),
  rr AS (SELECT qid, id, o AS score, row_number() OVER (PARTITION BY qid ORDER BY round(o, 9) DESC, rank, id) AS rank FROM ov)"""


@query(f"{_LEGS} SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM rr WHERE rank <= 10")
def rerank_topk(t) -> DataFrame:
    return ranking.rerank(bm25_ranking(t, 30), asked(t), corpus(t), 10).withColumn("score", r6(F.col("score")))


@query(
    f"""{_LEGS},
  n AS (SELECT qid, id, 0 AS leg, rank, 0.7 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part FROM rr WHERE rank <= 30 WINDOW w AS (PARTITION BY qid)
        UNION ALL SELECT qid, id, 1, rank, 0.3 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END FROM leg1 WINDOW w AS (PARTITION BY qid)),
  f AS (SELECT qid, id, sum(part) AS score, min(leg * 1000 + rank) AS seen FROM n GROUP BY 1, 2)
  SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, seen, id) AS rank FROM f) WHERE rank <= 10"""
)
def minmax_fusion(t) -> DataFrame:
    return fused(t, bm25_ranking(t, 30))


def fused(t, ranked: DataFrame) -> DataFrame:
    """A ranking fused with itself reranked; it is written first, so that both legs read it."""
    leg = store.materialized(ranked, "leg")
    other = ranking.rerank(leg, asked(t), corpus(t), 30)
    return ranking.fuse([(other, 0.7), (leg, 0.3)], 10).withColumn("score", r6(F.col("score")))


@query(
    f"""{_LEGS}, f AS (SELECT qid, id, sum(1.0 / (60 + rank)) AS score FROM (SELECT qid, id, rank FROM rr UNION ALL SELECT qid, id, rank FROM leg1) GROUP BY 1, 2)
  SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM f) WHERE rank <= 10"""
)
def rrf_fusion(t) -> DataFrame:
    leg = store.materialized(bm25_ranking(t, 30), "leg")
    return ranking.reciprocal_rank_fusion([ranking.rerank(leg, asked(t), corpus(t), 30), leg], 10).withColumn("score", r6(F.col("score")))


_POINT = "45 + ({0} * 37 % 1000) / 500.0 AS lat, 14 + ({0} * 91 % 1000) / 400.0 AS lon"
_KM = "12742 * asin(sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2)))"


def _points(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumns({"lat": 45 + (k * 37 % 1000) / 500.0, "lon": 14 + (k * 91 % 1000) / 400.0})


@query(
    f"""WITH a AS (SELECT s_suppkey AS anchor_id, {_POINT.format("s_suppkey")} FROM supplier), p AS (SELECT p_partkey AS place_id, {_POINT.format("p_partkey")} FROM part)
    SELECT anchor_id, place_id, round({_KM.format("a.lat", "a.lon", "p.lat", "p.lon")}, 6) AS km FROM a JOIN p ON anchor_id <> place_id AND {_KM.format("a.lat", "a.lon", "p.lat", "p.lon")} <= 10"""
)
def geo_range_join(t) -> DataFrame:
    a = _points(t("supplier").select(F.col("s_suppkey").alias("anchor_id")), "anchor_id")
    p = _points(t("part").select(F.col("p_partkey").alias("place_id")), "place_id")
    return geo.within(a, p, 10.0, digits=6)


@query(
    f"""WITH {BM25}, base AS (SELECT qid, id, rank, score FROM sparse WHERE rank <= 40 AND score > 0),
    pl AS (SELECT item_id AS qid, {_POINT.format("item_id")}, CASE item_id % 4 WHEN 0 THEN 10.0 WHEN 1 THEN 10.0 WHEN 2 THEN 50.0 END AS decay FROM benchmark),
    pt AS (SELECT doc_id AS id, {_POINT.format("doc_id")} FROM documents WHERE doc_id % 3 <> 0),
    sc AS (SELECT base.qid, base.id, base.rank, 0.7 * coalesce((score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0), 0)
             + 0.3 * coalesce(exp(-({_KM.format("pl.lat", "pl.lon", "pt.lat", "pt.lon")}) / decay), 1) AS score
           FROM base JOIN pl USING (qid) LEFT JOIN pt USING (id) WHERE decay IS NOT NULL WINDOW w AS (PARTITION BY base.qid)),
    o AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rank, id) AS rank FROM sc)
    SELECT qid AS query_id, rank, id AS chunk_id, round(score, 6) AS score FROM o WHERE rank <= 10
    UNION ALL SELECT base.qid, rank, id, round(score, 6) FROM base JOIN pl USING (qid) WHERE decay IS NULL AND rank <= 10"""
)
def geo_fuse(t) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("site", "town", "region", "country"))), (F.col("query_id") % 4 + 1).cast("int"))
    places = _points(asked(t).select("query_id"), "query_id").withColumn("granularity", kinds)
    points = _points(corpus(t).select(F.col("id").alias("chunk_id")).where("chunk_id % 3 <> 0"), "chunk_id")
    return geo.geo_rerank(bm25_ranking(t, 40), places, points, 10).withColumn("score", r6(F.col("score")))


@query(f"WITH {QRELS} SELECT qid AS question_id, id AS chunk_id FROM rel")
def evidence_qrels(t) -> DataFrame:
    return qrels(t)


@query(
    r"""WITH q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id AS page_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS quote FROM conversations WHERE turn = 0),
    c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS page_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations),
    s AS (SELECT question_id, page_id, quote, trim(p) AS part FROM q, unnest(string_split(regexp_replace(quote, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS u(p)),
    w AS (SELECT DISTINCT question_id, chunk_id FROM q JOIN c USING (page_id) WHERE contains(text, quote)),
    f AS (SELECT DISTINCT question_id, chunk_id FROM s JOIN c USING (page_id) WHERE length(part) >= 20 AND contains(text, part) AND question_id NOT IN (SELECT question_id FROM w))
    SELECT * FROM w UNION ALL SELECT * FROM f"""
)
def evidence_by_page(t) -> DataFrame:
    rows = t("conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    quotes = rows.where("turn = 0").select(F.col("key").alias("question_id"), F.col("conv_id").alias("page_id"), F.col("text").alias("quote"))
    return evaluation.evidence(quotes, rows.select(F.col("key").alias("chunk_id"), F.col("conv_id").alias("page_id"), "text"))


@query(
    r"""WITH x AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations),
    q AS (SELECT conv_id * 1000 + turn AS question_id, conv_id AS page_id, CASE WHEN turn % 2 = 0 THEN text ELSE 'nowhere ' || text END AS quote,
                 row_number() OVER (ORDER BY sha1((conv_id * 1000 + turn)::VARCHAR), conv_id * 1000 + turn) AS nth FROM x),
    pages AS (SELECT DISTINCT page_id FROM q WHERE nth <= 120),
    c AS (SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS page_id, text FROM x WHERE conv_id IN (FROM pages)),
    s AS (SELECT question_id, page_id, unnest(string_split(regexp_replace(quote, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS part FROM q),
    w AS (SELECT DISTINCT question_id, chunk_id FROM q JOIN c USING (page_id) WHERE contains(text, quote)),
    f AS (SELECT DISTINCT question_id, chunk_id FROM s JOIN c USING (page_id) WHERE length(trim(part)) >= 20 AND contains(text, trim(part)) AND question_id NOT IN (SELECT question_id FROM w)),
    e AS (FROM w UNION ALL FROM f),
    chosen AS (SELECT question_id FROM q WHERE question_id IN (SELECT question_id FROM e) ORDER BY nth LIMIT 60)
    SELECT question_id, chunk_id FROM e WHERE question_id IN (FROM chosen)"""
)
def evidence_of_sample(t) -> DataFrame:
    """Conversations as pages of chunks, each turn a question; every other quote begins with words that its page hasn't."""
    rows = t("conversations").withColumn("key", F.col("conv_id") * 1000 + F.col("turn"))
    quote = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("nowhere "), F.col("text")))
    questions = rows.select(F.col("key").alias("question_id"), F.col("conv_id").alias("page_id"), F.array(quote).alias("quotes"))
    path = store.fresh_path(rows.sparkSession, "chunks-by-page")
    evaluation.lay_by_page(rows.select(F.col("key").alias("chunk_id"), F.col("conv_id").alias("page_id"), "text"), path)
    return evaluation.sampled_evidence(questions, rows.sparkSession.read.parquet(path), 60)[1]


_PER = f"""WITH {BM25}, {QRELS}, r AS (SELECT rel.qid, rel.id, rank FROM rel LEFT JOIN (SELECT * FROM sparse WHERE rank <= 10 AND score > 0) s ON rel.qid = s.qid AND rel.id = s.id),
  per AS (SELECT qid, min(rank) AS first_rank, count(rank) / count(*)::DOUBLE AS recall FROM r GROUP BY 1)"""
_MEANS = "round(avg((coalesce(first_rank, 99) <= 1)::INT), 6) AS hit_1, round(avg((coalesce(first_rank, 99) <= 5)::INT), 6) AS hit_5, round(avg((coalesce(first_rank, 99) <= 10)::INT), 6) AS hit_10, round(avg(recall), 6) AS recall_10, round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr_10, count(*) AS questions"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c, kind in df.dtypes if kind == "double"})


@query(f"{_PER} SELECT {_MEANS} FROM per")
def retrieval_metrics(t) -> DataFrame:
    return _rounded(evaluation.metrics(qrels(t), bm25_ranking(t)))


@query(f"{_PER}, g AS (SELECT qid, min(lang) AS lang FROM rel JOIN documents ON id = doc_id GROUP BY 1) SELECT lang, {_MEANS} FROM per JOIN g USING (qid) GROUP BY lang")
def metrics_by_lang(t) -> DataFrame:
    q = qrels(t)
    langs = q.join(t("documents").select(F.col("doc_id").alias("chunk_id"), "lang"), "chunk_id").groupBy("question_id").agg(F.min("lang").alias("lang"))
    return _rounded(evaluation.metrics(q, bm25_ranking(t), by=langs, group="lang"))


@query(f"{_PER} SELECT qid AS question_id, first_rank FROM per")
def first_relevant_rank(t) -> DataFrame:
    return evaluation.per_question(qrels(t), bm25_ranking(t)).select("question_id", "first_rank")


@query(
    f"""{_PER}, o AS (SELECT qid, id, rank FROM sparse WHERE rank <= 10 AND score > 0), x AS (SELECT rel.qid, min(rank) AS f FROM rel JOIN sparse s ON s.qid = rel.qid AND s.id = rel.id AND rank <= 3 GROUP BY 1)
    SELECT per.qid AS question_id, 'passage' AS qtype, left(text, 80) AS question, coalesce(first_rank::VARCHAR, '-') AS sparse, coalesce(f::VARCHAR, '-') AS short
    FROM per JOIN benchmark ON item_id = per.qid LEFT JOIN x ON x.qid = per.qid"""
)
def rank_table(t) -> DataFrame:
    full = store.materialized(bm25_ranking(t), "ranking")
    both = full.withColumn("method", F.lit("sparse")).unionByName(full.where("rank <= 3").withColumn("method", F.lit("short")))
    questions = t("benchmark").select(F.col("item_id").alias("question_id"), F.lit("passage").alias("qtype"), "text")
    return evaluation.rank_table(qrels(t), both, questions, ["sparse", "short"])


@query(f"WITH {BM25} SELECT round(avg(n), 6) AS chars FROM (SELECT qid, sum(length(text)) AS n FROM sparse JOIN documents ON id = doc_id WHERE rank <= 10 AND score > 0 GROUP BY 1)")
def chars_at_k(t) -> DataFrame:
    return _rounded(evaluation.chars_at_k(bm25_ranking(t), corpus(t)))


@query("SELECT lang AS size, count(*) AS chunks, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY 1")
def size_profile(t) -> DataFrame:
    return _rounded(evaluation.size_profile(t("documents").select(F.col("lang").alias("size"), "text")))


@query("SELECT doc_id, length(text) AS chars FROM documents")
def char_counts(t) -> DataFrame:
    return t("documents").select("doc_id", F.length("text").alias("chars"))


@query("SELECT doc_id AS question_id FROM labels WHERE quality = 1 ORDER BY sha1(doc_id::VARCHAR), doc_id LIMIT 50")
def stable_sample(t) -> DataFrame:
    return evaluation.stable_sample(t("labels").where("quality = 1").select(F.col("doc_id").alias("question_id")), 50)


@query(
    f"""WITH {BM25}, r AS (SELECT doc_id, toxic = 1 AS truth, coalesce(quality, 0) = 0 AS low, length(text) < 500 AS short FROM labels JOIN documents USING (doc_id))
    SELECT rule, round(sum((p AND truth)::INT) / greatest(sum(p::INT), 1.0), 6) AS precision, round(sum((p AND truth)::INT) / greatest(sum(truth::INT), 1.0), 6) AS recall
    FROM (SELECT 'low' AS rule, low AS p, truth FROM r UNION ALL SELECT 'short', short, truth FROM r) GROUP BY 1"""
)
def predictor_quality(t) -> DataFrame:
    rows = t("labels").join(t("documents"), "doc_id").select((F.col("toxic") == 1).alias("truth"), (F.coalesce("quality", F.lit(0)) == 0).alias("low"), (F.length("text") < 500).alias("short"))
    return _rounded(evaluation.predictor_quality(rows, {"low": "low", "short": "short"}))


@query()
def chunk_pages_all_sizes(t) -> DataFrame:
    return chunk_pages(t("documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("doc "), "doc_id").alias("title"), "text"))


@query("SELECT doc_id, sha1(doc_id::VARCHAR) AS position FROM documents")
def stable_positions(t) -> DataFrame:
    return t("documents").select("doc_id", stable_order(F.col("doc_id")).alias("position"))


@query(r"SELECT item_id, len(list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) >= 20)) AS sentences FROM benchmark")
def sentence_counts(t) -> DataFrame:
    long = F.filter(T.sentences(F.col("text")), lambda s: F.length(F.trim(s)) >= 20)
    return t("benchmark").select("item_id", F.size(long).alias("sentences"))
