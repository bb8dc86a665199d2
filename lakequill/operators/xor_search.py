"""The candidate whose id gives the least crc32(own id + candidate's id), without comparing pairs.

CRC-32 is affine over XOR: crc(a + b) = crc(a + zeros) ^ crc(zeros) ^ crc(b), with as many zero bytes as b has. Among
candidates of one length, the least hash is thus the least XOR of a number that only the asking id decides with the
candidates' own checksums: a walk down a binary trie of these checksums. The trie is a table: for each prefix of whole
bytes the bytes that follow it, 256 at most. A walk is four equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators.store import materialized

LEVELS = 4


def _checksum(value: Column) -> Column:
    return F.crc32(value)


def _bytes(id_: Column) -> Column:
    return id_.cast("string").cast("binary")


def least_hash_partner(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, partner) of rows (id, item, keys ...): of the rows with equal keys and another item, over all rows of the id, the id with the least crc32(id + partner); ties go to the smaller one.

    A row may stand in several groups. Ids, items and keys that are null have no partner and are none. A node of the
    trie that holds one item only tells which, so that walks of that item pass it by.
    """
    held = rows.dropna(subset=["id", "item", *keys]).select("id", "item", *keys).distinct()
    c = _checksum(_bytes(F.col("id")))
    leaves = held.select("id", "item", *keys, F.octet_length(F.col("id").cast("string")).alias("length"), c.alias("c"))
    node = [*keys, "length"]
    levels = F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright("c", 32 - 8 * k).alias("prefix"), F.shiftright("c", 24 - 8 * k).bitwiseAND(F.lit(255)).cast("int").alias("byte")) for k in range(LEVELS))))
    children = leaves.select("item", *node, levels.alias("x")).select("item", *node, "x.*")
    children = children.groupBy(*node, "level", "prefix", "byte").agg(F.min("item").alias("low"), F.max("item").alias("high"))
    child = F.struct("byte", F.when(F.col("low") == F.col("high"), F.col("low")).alias("only"))
    trie = materialized(children.groupBy(*node, "level", "prefix").agg(F.collect_list(child).alias("children")), "trie")  # 256 bytes at most

    zeros = F.repeat(F.lit("\0"), F.col("length")).cast("binary")
    lengths = trie.where("level = 0").select(*node)
    walk = held.join(lengths, keys).select("id", "item", *node, F.lit(0).cast("bigint").alias("prefix"), _checksum(F.concat(_bytes(F.col("id")), zeros)).bitwiseXOR(_checksum(zeros)).alias("x"))
    for k in range(LEVELS):
        own = F.shiftright("x", 24 - 8 * k).bitwiseAND(F.lit(255)).cast("int")
        step = walk.join(trie.where(F.col("level") == k).drop("level"), [*node, "prefix"]).withColumn("own", own)
        open_ = F.filter("children", lambda n: n["only"].isNull() | (n["only"] != F.col("item")))
        best = F.array_min(F.transform(open_, lambda n: n["byte"].bitwiseXOR(F.col("own")))).bitwiseXOR(F.col("own"))
        walk = step.select("id", "item", *node, (F.col("prefix") * 256 + best).alias("prefix"), "x").where("prefix is not null")

    # Ids of equal length and checksum: the two smallest, of different items, answer every walk.
    least = leaves.groupBy(*node, "c", "item").agg(F.min("id").alias("id"))
    first = Window.partitionBy(*node, "c").orderBy("id", "item")
    ends = least.withColumn("nth", F.row_number().over(first)).where("nth <= 2").groupBy(*node, F.col("c").alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("ends"))
    met = walk.join(ends, [*node, "prefix"]).withColumn("end", F.get(F.filter("ends", lambda e: e["item"] != F.col("item")), F.lit(0))["id"]).where("end is not null")
    order = F.struct(F.col("prefix").bitwiseXOR(F.col("x")).alias("k"), F.col("end").alias("o"))
    return met.groupBy("id").agg(F.min_by("end", order).alias("partner"))
