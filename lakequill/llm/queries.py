"""The thin queries opN_<name> over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.llm.centroids import centroid_clusters
from lakequill.llm.common import documents, text_of
from lakequill.llm.exact_dedup import exact_dedup
from lakequill.llm.fingerprint import fingerprints
from lakequill.llm.html_extract import extract
from lakequill.llm.mixing import mix
from lakequill.llm.periodic_runs import best_run, periodic_runs, planted
from lakequill.llm.secret_scan import secret_scan
from lakequill.llm.sentencepiece_bpe import encode
from lakequill.llm.simhash import hex_of, near_duplicates
from lakequill.llm.suffix_dedup import repeated_passages
from lakequill.llm.threshold_search import top_inner_products
from lakequill.llm.toxicity import toxicity
from lakequill.llm.url_filter import Rule, url_filter

#: Fixed by the contract of op10: (host, path, verdict).
URL_RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), (F.size("spans") > 0).cast("int").alias("repeated"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(documents(spark, sf_dir).select("doc_id", "text", "source"))


def token_digests(tokens: DataFrame, *more: Column) -> DataFrame:
    return tokens.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode(documents(spark, sf_dir).select("doc_id", "text"), piece_model(), decoded=True))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Fixed by the contract of op11: of each document with crc32(id) % 10 = 0 the words from a place on become periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", text_of(F.col("text")).alias("text"), h.alias("h"), F.expr("h div 10").alias("g"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    held = held.select("doc_id", "text", "g", F.when(chosen, words).alias("words"))
    n = F.size("words")
    start = F.when(n > 0, (F.col("g") % n).cast("int"))
    held = held.select("doc_id", "text", "g", "words", start.alias("a"))
    period = (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int")
    held = held.select("doc_id", "text", "words", "a", period.alias("p"))
    return held.select("doc_id", F.coalesce(F.array_join(planted(F.col("words"), F.col("a"), F.col("p")), " "), F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(documents(spark, sf_dir).select("doc_id", "text"))).drop("text")
    found = found.withColumn("best", best_run(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("best.length"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extraction": op5_html_extraction,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_filter": op10_url_filter,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_topk_search": op13_topk_search,
}

#: A-Z only, as the operators fold them.
ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Of a vector: every component there and finite.
FINITE = "embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _runs_sql() -> str:
    """Equal words of a document within a third of its length, then stretches of neighbours with one distance."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return rf"""
        WITH RECURSIVE crc(k, i, c) AS (SELECT k, 0, k::BIGINT FROM range(256) AS g(k) UNION ALL SELECT k, i + 1, {step} FROM crc WHERE i < 8),
        t AS MATERIALIZED (SELECT list(c ORDER BY k) AS t FROM crc WHERE i = 8),
        d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        f(r, i, s, c) AS (SELECT r, 0, doc_id::VARCHAR, 4294967295::BIGINT FROM d
                          UNION ALL SELECT r, i + 1, s, xor(c >> 8, t[1 + (xor(c, ascii(s[i + 1])) & 255)]) FROM f CROSS JOIN t WHERE i < length(s)),
        h AS (SELECT r, xor(c, 4294967295) AS h FROM f WHERE i = length(s)),
        a AS (SELECT d.*, h, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d JOIN h USING (r)),
        p AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a),
        x AS MATERIALIZED (SELECT r, doc_id, n, i, CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[i + 1] END AS w
                           FROM (SELECT *, unnest(range(n)) AS i FROM p)),
        e AS MATERIALIZED (SELECT u.r, u.i, v.i - u.i AS q FROM x u JOIN x v ON u.r = v.r AND u.w = v.w AND v.i > u.i AND v.i - u.i <= u.n // 3),
        b AS (SELECT r, q FROM e GROUP BY r, q HAVING count(*) >= greatest(24 - q, 2 * q)),
        o AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM e SEMI JOIN b USING (r, q)),
        s AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM o GROUP BY r, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
        k AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM s GROUP BY r, start, length),
        m AS (SELECT r, start, length, period, row_number() OVER (PARTITION BY r ORDER BY length::DOUBLE / period DESC, start, period) AS z FROM k),
        c AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM k GROUP BY r),
        g AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM k),
        j AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS kept FROM x ANTI JOIN g USING (r, i) GROUP BY r)
        SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
               sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM d LEFT JOIN c USING (r) LEFT JOIN j USING (r) LEFT JOIN (SELECT * FROM m WHERE z = 1) USING (r)"""


def _clustering_sql(rounds: int = 3) -> str:
    assign = """a{0} AS MATERIALIZED (SELECT vec_id, q, cluster, d FROM (
          SELECT vec_id, q, cluster, d, row_number() OVER (PARTITION BY vec_id, n ORDER BY d, cluster) AS r FROM (
            SELECT vec_id, n, q, cluster, list_sum([(q[i] - c[i]) * (q[i] - c[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM v CROSS JOIN c{0})) WHERE r = 1)"""
    move = """m{1} AS (SELECT cluster, list(CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END ORDER BY i) AS c
          FROM (SELECT cluster, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{0} CROSS JOIN range(1, 65) AS g(i) GROUP BY cluster, i) GROUP BY cluster),
        c{1} AS MATERIALIZED (SELECT c{0}.cluster, coalesce(m{1}.c, c{0}.c) AS c FROM c{0} LEFT JOIN m{1} USING (cluster))"""
    steps = ",\n        ".join(f"{assign.format(i)},\n        {move.format(i, i + 1)}" for i in range(rounds)) + ",\n        " + assign.format(rounds)
    return f"""
        WITH v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS n, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND {FINITE}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), q) - 1 AS cluster, q AS c FROM v ORDER BY sha256('1:' || vec_id), q LIMIT 16),
        {steps}
        SELECT vec_id, cluster::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"""


ORACLE: dict[str, str] = {
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_url_filter": f"""
        WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (SELECT page_id, {ASCII_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
        rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
                 FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)""",
    "op8_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
        e AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size, md5('8|' || doc_id || '|' || t) AS tie, length(t) AS n,
                     (length(t) - length(regexp_replace(t, '[\p{L}\p{M}\x20\x09-\x0D]+', '', 'g')))::DOUBLE AS letters FROM d),
        k AS (SELECT *, -ln((('0x' || substr(tie, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
                        / greatest(0.01::DOUBLE, CASE WHEN n = 0 THEN 0.01::DOUBLE ELSE (letters / n) * (letters / n) END) AS key FROM e),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
        w AS (SELECT *, source_size * 3::DOUBLE AS cap, ([5.0, 2.0, 1.0]::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
        v AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT max(level) AS final FROM v WHERE cap / w >= level),
        t AS (SELECT source, source_size, least(cap, coalesce(w * final, cap)) AS target FROM v CROSS JOIN f),
        b AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END AS epochs FROM t),
        o AS (SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, round(b.target)::BIGINT - b.epochs * b.source_size AS budget,
                     coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.tie, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
              FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - used)))::BIGINT AS taken FROM o""",
    "op11_periodic_runs": _runs_sql(),
    "op12_centroid_clustering": _clustering_sql(),
    "op13_topk_search": f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE {FINITE}),
        s AS (SELECT a.n, a.vec_id AS query_id, b.vec_id, list_sum([coalesce(a.q[i] * b.q[i], 0) FOR i IN range(1, len(a.q) + 1)])::BIGINT AS score
              FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
