"""Driver queries of what is kept between runs and of what models reply: progress, caches, replies, label specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import labels, qa, replies
from lakequill.operators.places import places_of
from lakequill.operators.store import fresh_path
from lakequill.plans.build_queries import rule_inputs
from lakequill.plans.registry import ORACLE, query
from lakequill.sources.versioned import Versioned, resume


def _table(df: DataFrame, label: str) -> Versioned:
    return Versioned(df.sparkSession, fresh_path(df.sparkSession, label))


@query(ORACLE["rule_flags"])
def incremental_rule_checks(t) -> DataFrame:
    """The rule checks in two runs with one progress table: first of the conversations that have been fetched so far, then of all; the second checks those that are new."""
    items, pages = rule_inputs(t)
    done = _table(items, "rule-checks")
    so_far = t("conversations").agg(F.expr("percentile(conv_id, 0.6)").alias("last"))
    first = items.join(F.broadcast(so_far), F.col("page_id") <= F.col("last"))
    for fetched in (first.drop("last"), items):
        resume(fetched, "page_id", done, lambda fresh: qa.rule_flags(fresh, pages), groups=2)
    return done.read().select("page_id", "n", F.array_join("flags", ",").alias("flags"))


@query(
    r"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS k FROM conversations),
    r AS (SELECT query_id, round, length(k) AS n FROM q, (VALUES (1), (2)) AS v(round))
    SELECT query_id, round::INTEGER AS round, CASE WHEN n % 5 = 0 AND round = 1 THEN 'failed' WHEN n % 5 IN (1, 2) THEN 'none' ELSE 'place' END AS state,
           CASE WHEN n % 5 IN (3, 4) OR n % 5 = 0 AND round = 2 THEN (n % 90)::DOUBLE END AS lat FROM r"""
)
def place_cache_rounds(t) -> DataFrame:
    """Two rounds over all turns: the lookup fails for a fifth of the keys in the first, and in the second is only asked for these; it would then put all others at the pole."""
    asked = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    cache = _table(asked, "place-cache")
    n = F.length("key")
    point = lambda found, lat: found.select("key", F.when(~(n % 5).isin(1, 2), lat).alias("lat"), F.when(~(n % 5).isin(1, 2), F.lit(15.0)).alias("lon"), F.when(~(n % 5).isin(1, 2), F.lit(10.0)).alias("decay_km"))
    first = places_of(asked, cache, lambda keys: point(keys.where(n % 5 != 0), (n % 90).cast("double")))
    second = places_of(asked, cache, lambda keys: point(keys, F.when(n % 5 == 0, (n % 90).cast("double")).otherwise(F.lit(90.0))))
    rounds = [df.select("query_id", F.lit(i).alias("round"), "state", "lat") for i, df in ((1, first), (2, second))]
    return rounds[0].unionByName(rounds[1])


@query(
    r"""WITH c AS (SELECT conv_id * 1000 + turn AS request_id, turn % 6 AS shape, text, lower(text) AS q FROM conversations)
    SELECT request_id, n::INTEGER AS n, CASE WHEN n = 1 AND shape = 4 THEN NULL ELSE text || ' ' || n END AS question, CASE WHEN n = 1 AND shape = 4 THEN NULL WHEN shape = 1 THEN q || ' key' ELSE q END AS query,
           CASE WHEN n = 1 AND shape = 4 THEN NULL WHEN shape <> 2 THEN n = 0 END AS good, CASE WHEN n = 1 AND shape = 4 THEN 'no object' END AS error
    FROM c, range(2) AS r(n) WHERE shape <> 5
    UNION ALL SELECT request_id, NULL, NULL, NULL, NULL, 'no items' FROM c WHERE shape = 5"""
)
def repaired_replies(t) -> DataFrame:
    """A reply for each turn, in six shapes: wrapped, keywords as a list, a flag that is no boolean, a bare list with nested labels, a text among the items, cut off."""
    c = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), (F.col("turn") % 6).alias("shape"), "text")
    item = lambda i, query, good: F.struct(F.concat("text", F.lit(f" {i}")).alias("question"), query.alias("query"), good.alias("good"))
    both = lambda query, good: F.array(*(item(i, query, good(i)) for i in range(2)))
    plain, flag = F.lower("text"), lambda i: F.lit(i == 0)
    wrapped = F.to_json(F.struct(both(plain, flag).alias("items")))
    keys = F.to_json(F.struct(both(F.array(plain, F.lit("key")), flag).alias("items")))
    odd = F.to_json(F.struct(both(plain, lambda i: F.array(F.lit(i))).alias("items")))
    nested = F.to_json(F.transform(both(plain, flag), lambda x: F.struct(F.lit(0).alias("item"), x.alias("labels"))))
    text_among = F.concat(F.lit('{"items": ['), F.to_json(item(0, plain, flag(0))), F.lit(', "and so on"]}'))
    cut = F.left(wrapped, F.length(wrapped) - 3)
    reply = F.element_at(F.array(wrapped, keys, odd, nested, text_among, cut), (F.col("shape") + 1).cast("int"))
    return replies.reply_items(c.select("request_id", reply.alias("reply")), "request_id", {"question": "string", "query": "string", "good": "boolean"}, nested="labels", joined=["query"])


def _specs_sql() -> str:
    rows = [(name, pos, label, options) for name, spec in SPECS.items() for pos, (label, options) in enumerate(spec.items())]
    values = ", ".join(f"('{name}', {pos}, '{label}', [{', '.join(repr(o) for o in options)}])" for name, pos, label, options in rows)
    return f"""WITH s(spec, pos, label, options) AS (VALUES {values}),
    d AS (SELECT doc_id, spec, pos, label, options, (doc_id + 7 * pos) % (len(options) + 2) AS h FROM documents, s),
    v AS (SELECT *, CASE WHEN h < len(options) THEN options[h + 1] WHEN h = len(options) THEN 'odd' END AS value FROM d)
    SELECT doc_id, spec, string_agg(CASE WHEN h < len(options) THEN h::VARCHAR ELSE '-' END, ',' ORDER BY pos) AS indices,
           coalesce(string_agg(CASE WHEN h < len(options) THEN label || '=' || value END, ',' ORDER BY label), '') AS labels,
           concat_ws(';', string_agg(CASE WHEN value IS NULL THEN 'missing ' || label WHEN value = 'odd' THEN label || ': odd' END, ';' ORDER BY pos), CASE WHEN doc_id % 3 = 0 THEN 'unknown mood' END) AS problems
    FROM v GROUP BY doc_id, spec"""


SPECS = {"question": labels.QUESTION, "triple": labels.TRIPLE, "page": labels.PAGE}


@query(_specs_sql())
def label_specs(t) -> DataFrame:
    """For each document and specification labels with right, odd, missing and unknown values: class indices, what these stand for, what is wrong."""
    d, out = t("documents").select("doc_id"), None
    for name, spec in SPECS.items():
        value = lambda i, options: F.get(F.array(*map(F.lit, [*options, "odd"])), ((F.col("doc_id") + 7 * i) % (len(options) + 2)).cast("int"))
        pairs = [F.struct(F.lit(label).alias("key"), value(i, options).alias("value")) for i, (label, options) in enumerate(spec.items())]
        mood = F.when(F.col("doc_id") % 3 == 0, F.struct(F.lit("mood").alias("key"), F.lit("fine").alias("value")))
        given = F.map_from_entries(F.filter(F.array(*pairs, mood), lambda p: p["value"].isNotNull()))
        rows = d.select("doc_id", F.lit(name).alias("spec"), given.alias("given")).withColumn("ix", labels.class_indices(spec, F.col("given")))
        again = F.array_sort(F.transform(F.map_entries(labels.labels_of(spec, F.col("ix"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
        shown = F.transform("ix", lambda i: F.coalesce(i.cast("string"), F.lit("-")))
        part = rows.select("doc_id", "spec", F.array_join(shown, ",").alias("indices"), F.array_join(again, ",").alias("labels"), F.array_join(labels.problems(spec, F.col("given")), ";").alias("problems"))
        out = part if out is None else out.unionByName(part)
    return out
