"""Similar word sets within groups, by a set-similarity join with size and prefix filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import jaccard
from lakequill.operators.sizes import small_or_shuffled

#: Rows of a group that are compared where they lie together.
TOGETHER = 64


def earlier_similar(sets: DataFrame, group: str, order: str, words: str, threshold: float = 0.8) -> DataFrame:
    """(group, order), distinct, of rows whose word set has that Jaccard with the set of a row of the group that comes earlier.

    Groups of at most TOGETHER rows cross one shuffle and are compared in place; the sets of larger ones meet on their
    rarest words, so no group is held whole beyond that number. Empty sets are similar to nothing; rows with a null group
    or place aren't compared.
    """
    placed = sets.where(F.col(group).isNotNull() & F.col(order).isNotNull()).select(F.col(group).alias("g"), F.col(order).alias("at"), F.col(words).alias("words"))
    crowded = small_or_shuffled(placed.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TOGETHER).select("g"))
    own = placed.withColumn("words", F.array_sort(F.array_distinct(F.array_compact("words"))))
    few, many = (own.join(crowded, "g", kind).where(F.size("words") > 0) for kind in ("left_anti", "left_semi"))
    found = _compared(few, threshold).unionByName(_met(many, threshold))
    return found.distinct().select(F.col("g").alias(group), F.col("at").alias(order))


def _compared(own: DataFrame, threshold: float) -> DataFrame:
    """(g, at) of own (g, at, words), the rows of each g gathered."""
    held = own.groupBy("g").agg(F.collect_list(F.struct("at", "words", F.size("words").alias("size"))).alias("sets"))
    small = lambda a, b: F.least(a["size"], b["size"]) >= F.greatest(a["size"], b["size"]) * F.lit(threshold) - 1e-9
    alike = lambda a, b: F.exists(F.array(F.size(F.array_intersect(a["words"], b["words"]))), lambda n: n / (a["size"] + b["size"] - n) >= threshold)
    later = F.filter("sets", lambda a: F.exists("sets", lambda b: (b["at"] < a["at"]) & small(a, b) & alike(a, b)))
    return held.select("g", F.explode(F.transform(later, lambda a: a["at"])).alias("at"))


def _met(own: DataFrame, threshold: float) -> DataFrame:
    """(g, at) of own (g, at, words), by a join on rare words.

    Equal sets of a group are one set at its earliest place: its later rows are found at once, however many there are.
    Two sets of sizes a <= b can only be similar if a >= threshold * b, and if among the a - ceil(threshold * a) + 1
    rarest words of the one stands one of the other's. Rows of single words carry the set's place and hash, not its words.
    """
    first = own.groupBy("g", "words").agg(F.min("at").alias("first")).withColumn("h", F.xxhash64("words"))
    copies = own.join(first, ["g", "words"]).where(F.col("at") > F.col("first")).select("g", "at")

    entries = first.select("g", "first", "h", F.size("words").alias("size"), F.explode("words").alias("word"))
    df = entries.groupBy("g", "word").agg(F.count(F.lit(1)).alias("df")).where("df > 1")  # a word of one set brings nothing together
    shared = entries.join(df, ["g", "word"]).groupBy("g", "first", "h", "size").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("rare"))  # a set's own words
    size = F.col("size")
    most = (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1) - (size - F.size("rare"))  # words of no other set are the rarest
    heads = shared.select("g", "first", "h", "size", F.explode(F.slice("rare", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))).alias("w")).select("g", "first", "h", "size", F.col("w.word").alias("word"))
    a, b = heads.alias("a"), heads.alias("b")
    small, large = F.least("a.size", "b.size"), F.greatest("a.size", "b.size")
    meet = (F.col("a.g") == F.col("b.g")) & (F.col("a.word") == F.col("b.word")) & (F.col("b.first") < F.col("a.first")) & (small >= large * F.lit(threshold) - 1e-9)
    pairs = a.join(b, meet).select(F.col("a.g").alias("g"), F.col("a.first").alias("at"), F.col("a.h").alias("at_h"), F.col("b.first").alias("before"), F.col("b.h").alias("before_h")).distinct()
    at, before = (first.select("g", F.col("first").alias(n), F.col("h").alias(f"{n}_h"), F.col("words").alias(f"{n}_words")) for n in ("at", "before"))
    near = pairs.join(at, ["g", "at", "at_h"]).join(before, ["g", "before", "before_h"]).where(jaccard(F.col("at_words"), F.col("before_words")) >= threshold).select("g", "at")
    return copies.unionByName(near)
