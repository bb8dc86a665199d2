"""Replies of models as rows, whatever shape the model gave them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def reply_items(replies: DataFrame, key: str, fields: Mapping[str, str], wrapper: str = "items", nested: str | None = None, joined: Sequence[str] = ()) -> DataFrame:
    """(key, n, the fields ..., error): the items of JSON replies (key, reply), by place; a reply that gives none is one row with an error.

    A reply is an object with its items under `wrapper`, or just their list. An item may carry its fields under `nested`
    instead of bearing them itself. Fields are cast to their types, null where that fails or they are absent; of a field
    in `joined` a list of texts counts as the texts joined by blanks. Null replies, other JSON and text that is no JSON
    are 'no items'; what stands where an item should be but is no object is an item without fields and has 'no object'.
    """
    v = replies.select(key, F.try_parse_json("reply").alias("v"))
    inside = F.try_variant_get("v", f"$.{wrapper}", "variant")
    listed = F.when(_is(F.col("v"), "ARRAY"), F.col("v")).when(_is(F.col("v"), "OBJECT") & _is(inside, "ARRAY"), inside)
    rows = v.select(key, F.try_variant_get(listed, "$", "array<variant>").alias("list"))
    none = rows.where("list is null").select(key, F.lit(None).cast("int").alias("n"), F.lit(None).cast("variant").alias("x"), F.lit("no items").alias("error"))
    some = rows.where("list is not null").select(key, F.posexplode("list").alias("n", "x"))
    if nested:
        deeper = F.try_variant_get("x", f"$.{nested}", "variant")
        some = some.withColumn("x", F.when(_is(F.col("x"), "OBJECT") & _is(deeper, "OBJECT"), deeper).otherwise(F.col("x")))
    some = some.select(key, "n", "x", F.when(~_is(F.col("x"), "OBJECT"), F.lit("no object")).alias("error"))

    def field(name: str, kind: str) -> Column:
        at = f"$.{name}"
        plain = F.try_variant_get("x", at, kind)
        if name not in joined:
            return plain
        part = F.try_variant_get("x", at, "variant")
        return F.when(_is(part, "ARRAY"), F.array_join(F.try_variant_get("x", at, "array<string>"), " ")).otherwise(plain)

    return some.unionByName(none).select(key, "n", *(field(name, kind).alias(name) for name, kind in fields.items()), "error")
