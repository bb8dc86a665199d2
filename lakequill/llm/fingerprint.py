"""Canonical exact fingerprints with DataFrame functions only.

A text's canonical form is its NFKC form, case-folded, white space folded. Its fingerprint is a 128-bit digest of two
chained xxHash64 values. Texts that share a digest are compared byte by byte; should two canonical forms ever share
one, all but the first get a numbered fingerprint, so equal fingerprints always mean equal canonical texts.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import column, small_or_not, text_of, written


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again, every run of white space one blank, trimmed. The Unicode tables are those of the ICU library in Spark."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def wide_digest(canon: Column) -> Column:
    """128 bits: the second half hashes the text under another seed."""
    return F.struct(F.xxhash64(canon).alias("hi"), F.xxhash64(F.lit("wide"), canon).alias("lo"))


def _hex(digest: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(digest[k]), 16, "0") for k in ("hi", "lo"))))


def _range_of(ids: Column, kind: str, starts: list) -> Column:
    """The number of starts (rising) that aren't above the id, nulls -1: a search in two steps, over every so many starts and then between two of them."""
    wide = max(1, math.isqrt(len(starts)))
    steps = [starts[i : i + wide] for i in range(0, len(starts), wide)]
    held = lambda value, type_: F.from_json(F.lit(json.dumps(value, default=str)), type_)  # noqa: E731  folded to a constant
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= ids))
    step = below(held([s[0] for s in steps], f"array<{kind}>"))
    found = F.when(step == 0, 0).otherwise((step - 1) * wide + below(F.get(held(steps, f"array<array<{kind}>>"), step - 1)))
    return F.when(ids.isNull(), -1).otherwise(found).cast("long")


def with_next(docs: DataFrame, ordered: list[Column], carried: list[str], id_col: str, ranges: int | None = None) -> DataFrame:
    """docs with next_<c> for each carried column: that of the next row by descending id (ties by the ordered columns), after the last the first.

    The ids alone are dealt into ranges of about equal numbers by Spark's sampling; the rows then meet by range, and each
    range also gets the first rows of the next one, so one shuffle of the rows answers it and no task sees more than its
    ranges, however the ids lie. ranges: their number, as many as shuffle partitions by default.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    ids = docs.select(F.col(id_col).alias("id"))
    many = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    lows = ids.where("id is not null").repartitionByRange(many, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("low"))
    starts = sorted({r["low"] for r in lows.collect()})  # a row for each range at most
    block = _range_of(F.col(id_col), kind, starts) if starts else F.lit(-1).cast("long")
    first = ids.withColumnRenamed("id", id_col).groupBy(block.alias("block")).agg(F.max(id_col).alias("id")).orderBy(F.desc("block")).collect()  # and one for null ids
    before = {r["block"]: first[i - 1]["block"] for i, r in enumerate(first)}
    edges = spark.createDataFrame([(r["id"], before[r["block"]]) for r in first], f"__edge {kind}, __to long")
    placed = docs.withColumn("__block", block).join(F.broadcast(edges), F.col(id_col).eqNullSafe(F.col("__edge")), "left")
    copies = F.array(F.struct(F.lit(0).alias("copy"), F.col("__block").alias("block")), F.struct(F.lit(1).alias("copy"), F.col("__to").alias("block")))
    dealt = placed.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.slice(copies, 1, 1)).otherwise(copies))).drop("__edge", "__to", "__block")
    window = Window.partitionBy("__at.block").orderBy("__at.copy", F.col(id_col).desc_nulls_last(), *ordered)
    return dealt.select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in carried)).where("__at.copy = 0").drop("__at")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = wide_digest) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    edited: the last floor(n/2) code points replaced by the first as many (or all) of the next document by descending
    id; after the last comes the first, so a lone document follows itself. Ids that repeat are ordered by their texts'
    digests, null ids come last. Likeness is 1.0 for equal canonical texts, compared byte by byte, else 0.0: an exact
    digest knows no other. A null text is empty; an empty table gives an empty result.
    """
    base = docs.select(column(docs, id_col).alias("id"), text_of(column(docs, text_col)).alias("text"))
    keyed = base.withColumn("canon", canonical(F.col("text"))).select("id", "text", digest(F.col("canon")).alias("d"))
    paired = with_next(keyed, [F.col("d"), F.col("text")], ["text", "d"], "id")
    n = F.length("text")
    edited = F.concat(F.expr("substring(text, 1, int(length(text) - length(text) div 2))"), F.expr("substring(next_text, 1, int(length(text) div 2))"))
    pairs = paired.withColumns({"n_chars": n.cast("long"), "edited": edited}).withColumn("e_canon", canonical(F.col("edited"))).withColumn("e", digest(F.col("e_canon")))
    same = lambda other, canon: F.when(F.col("d") == F.col(other), (canonical(F.col("text")) == canon).cast("double")).otherwise(0.0)
    rows = written(
        pairs.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "d", "e", same("e", F.col("e_canon")).alias("near_edited"), same("next_d", canonical(F.col("next_text"))).alias("near_next")),
        "fingerprints",
    )
    numbered = _numbered(keyed, rows, digest)
    name = _hex(F.col("d"))
    if numbered is not None:
        rows = rows.join(numbered, rows["id"].eqNullSafe(numbered["__id"]) & (rows["d"] == numbered["__d"]), "left")
        name = F.concat(name, F.coalesce(F.concat(F.lit("-"), F.col("__k").cast("string")), F.lit("")))
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", name.alias("fingerprint"), _hex(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next")


def _numbered(keyed: DataFrame, rows: DataFrame, digest: Callable[[Column], Column]) -> DataFrame | None:
    """Byte comparison inside equal buckets: (id, digest, number from 2) of rows whose canonical text shares its digest with another text."""
    shared = written(rows.groupBy("d").count().where("count > 1").select(F.col("d").alias("__d")), "fingerprint-buckets")
    held = keyed.join(small_or_not(shared, shared.count()), keyed["d"] == shared["__d"], "left_semi").withColumn("canon", canonical(F.col("text"))).select("id", "d", "canon")
    mixed = held.groupBy("d").agg(F.min("canon").alias("low"), F.max("canon").alias("high")).where("low <> high").select(F.col("d").alias("__d"))
    mixed = written(mixed, "fingerprint-mixed")
    if mixed.isEmpty():
        return None
    held = held.join(mixed, held["d"] == mixed["__d"], "left_semi")
    texts = held.select("d", "canon").distinct().withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy("canon"))).where("k > 1")
    numbered = held.join(texts, ["d", "canon"]).select(F.col("id").alias("__id"), F.col("d").alias("__d"), F.col("k").alias("__k")).distinct()
    return written(numbered, "fingerprint-numbers")
