"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's key is an exponential variate over its quality weight. Whole epochs of a source come first; what is left
of its target is filled in ascending order of the keys, by prefix sums of the sizes. A source may hold a third of all
rows, so nothing sorts a source: its documents are counted in slices of the key range, one slice is the one in which
the target falls, and only that slice is sorted. What each document contributes then follows from one row for each source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import column, small_or_not, text_of, written

WORD = r"[^\x20\x09-\x0D]+"
LETTERS = r"[\p{L}\p{M}\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MOST_EPOCHS = 3.0
ROWS_A_SLICE = 1_000
#: The columns that mix adds.
ADDED = ("__size", "__source_size", "__target", "__taken")


def size_of(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def quality_of(text: Column) -> Column:
    """A weight over 0 to 1 from the text alone: the squared share of letters and blanks, 0.01 at least."""
    n = F.length(text)
    share = (n - F.length(F.regexp_replace(text, LETTERS, ""))) / F.nullif(n, F.lit(0))
    return F.greatest(F.lit(0.01), F.coalesce(share * share, F.lit(0.01)))


def _with_keys(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """docs with __size, __source, __key and __tie. The key's exponential variate comes from the first 52 bits of a digest of id and text, the tie from the rest."""
    text = text_of(column(docs, text_col))
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(column(docs, id_col).cast("string"), F.lit("")), text))
    uniform = (F.conv(F.left(F.col("__tie"), F.lit(13)), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)
    return docs.withColumns({"__size": size_of(column(docs, text_col)), "__source": column(docs, source_col).cast("string"), "__tie": digest}).withColumn("__key", -F.log(uniform) / quality_of(text))


def _ranged(df: DataFrame, order: Sequence[Column], sums: Sequence[str], label: str) -> DataFrame:
    """df with __place (from 0) and, for each column of sums, __before_<c>, in the order given. Ranges of rows are summed apart, so no task sees all rows."""
    table = written(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), label)
    ranges = table.groupBy("__range").agg(F.count(F.lit(1)).alias("__rows"), *(F.sum(c).alias(f"__of_{c}") for c in sums))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range: the number of shuffle partitions bounds them
    starts = ranges.select(F.col("__range").alias("__r"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in ("__rows", *(f"__of_{c}" for c in sums))))
    inside = Window.partitionBy("__range").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = table.join(F.broadcast(starts), F.col("__range") == F.col("__r"))
    return placed.select(*df.columns, (F.col("__rows_start") + F.row_number().over(inside) - 1).alias("__place"), *((F.col(f"__of_{c}_start") + F.coalesce(F.sum(c).over(run), F.lit(0))).alias(f"__before_{c}") for c in sums))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, n, source_size, target) of (source, n, source_size).

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating, and share the sum of all
    sizes; a target stops at `most` times its source's size and the excess goes to the others by weight until none is
    above. Filling by rising cap/weight gives that fixed point at once: the first k sources in this order are capped.
    """
    named = F.col("source").asc_nulls_last()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("__place"), F.lit(len(weights))) + 1).cast("int"))
    t = _ranged(sizes, [named], [], "mix-sources").withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = _ranged(t.drop("__place").withColumn("ratio", F.col("cap") / F.col("w")), [F.col("ratio"), named], ["cap", "w"], "mix-levels")
    total, heavy = t.agg(F.sum("source_size"), F.sum("w")).first()
    t = t.withColumn("level", (F.lit(float(total or 0)) - F.col("__before_cap")) / (F.lit(heavy or 0.0) - F.col("__before_w")))  # if all before are capped
    final = t.agg(F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level")))).first()[0]  # of the first source that isn't capped
    return t.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("w") * F.lit(final).cast("double"), F.col("cap")))).select("source", "n", "source_size", "target")


def _plan(keyed: DataFrame, weights: Sequence[float], most: float, split: bool) -> tuple[DataFrame, int]:
    """A row for each source: target, epochs, and where the fractional epoch ends (__cut, __cut_tie, __cut_words); and the number of sources."""
    narrow = written(keyed.select("__source", "__size", "__key", "__tie"), "mix-keys")
    sizes = narrow.groupBy(F.col("__source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("source_size"))
    targets = written(source_targets(sizes, weights, most), "mix-targets")
    many = targets.count()
    # The rounded target in whole epochs and a rest that is below the source's size, so the rest always ends inside the source.
    goal = F.round(F.col("target")).cast("long")
    targets = targets.withColumn("epochs", F.coalesce(F.floor(goal / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", goal - F.col("epochs") * F.col("source_size"))
    # Slices of the key range, in a form between 0 and 1 that rises with the key; their number follows the source's rows.
    slices = F.greatest(F.lit(1), F.ceil(F.col("n") / ROWS_A_SLICE))
    sliced = (
        narrow.join(small_or_not(targets, many), narrow["__source"].eqNullSafe(targets["source"]))
        .withColumn("slice", F.least(F.floor(F.col("__key") / (1 + F.col("__key")) * slices), slices - 1).cast("long"))
        .select("__source", "__size", "__key", "__tie", "budget", "slice")
    )
    sums = sliced.groupBy("__source", "slice").agg(F.sum("__size").alias("words"), F.first("budget").alias("budget"))
    run = Window.partitionBy("__source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("words").over(run), F.lit(0)))
    at = at.where("before <= budget and before + words > budget").select(F.col("__source").alias("s"), F.col("slice").alias("at"), "before")
    last = sliced.join(small_or_not(at, many), sliced["__source"].eqNullSafe(at["s"]) & (sliced["slice"] == at["at"]))
    last = last.groupBy("__source", "__key", "__tie", "__size", "budget", "before").agg(F.count(F.lit(1)).alias("rows"))  # repeated rows go together
    order = Window.partitionBy("__source").orderBy("__key", "__tie", "__size").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("used", F.col("before") + F.coalesce(F.sum(F.col("__size") * F.col("rows")).over(order), F.lit(0)))
    last = last.where("used <= budget and used + __size * rows > budget").withColumn("each", F.floor((F.col("budget") - F.col("used")) / F.col("rows")))
    words = F.col("each") if split else F.when(2 * F.col("each") >= F.col("__size"), F.col("__size")).otherwise(F.lit(0))
    cut = last.select(F.col("__source").alias("__cut_source"), F.col("__key").alias("__cut"), F.col("__tie").alias("__cut_tie"), words.cast("long").alias("__cut_words"))
    plan = targets.join(small_or_not(cut, many), targets["source"].eqNullSafe(cut["__cut_source"]), "left")
    plan = plan.select(F.col("source").alias("__of"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("epochs").alias("__epochs"), "__cut", "__cut_tie", "__cut_words")
    return written(plan, "mix-plan"), many


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, seed: int = 8, split: bool = True) -> DataFrame:
    """docs with __size, __source_size, __target and __taken, the words that the mix takes of each, repeats counted.

    Of each source whole epochs are taken first, then documents by ascending key until the target is met. The one at
    which it is met gives the words that are still missing (split) or is taken whole or not, whichever comes nearer.
    A null text has size 0 and takes 0; a null source is a source of its own and the last; rows that repeat in full
    share a key, count each and give the same words each; an empty table gives an empty result. Columns that docs has
    besides stay, but none may have the name of an added one; the same seed gives the same mix.
    """
    if clash := sorted(set(docs.columns) & set(ADDED)):
        raise ValueError(f"docs has columns that are added: {', '.join(clash)}")
    return _mixed(docs, id_col, text_col, source_col, weights, most, seed, split).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)), *ADDED)


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], most: float, seed: int, split: bool) -> DataFrame:
    """The columns of docs as c0, c1, ..., so that none can clash, and the added ones."""
    name = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    keyed = _with_keys(docs.toDF(*name.values()), name[id_col], name[text_col], name[source_col], seed)
    plan, many = _plan(keyed, weights, most, split)
    out = keyed.join(small_or_not(plan, many), F.col("__source").eqNullSafe(F.col("__of")))
    below = (F.col("__key") < F.col("__cut")) | ((F.col("__key") == F.col("__cut")) & (F.col("__tie") < F.col("__cut_tie")))
    equal = (F.col("__key") == F.col("__cut")) & (F.col("__tie") == F.col("__cut_tie"))
    part = F.when(F.col("__cut").isNull(), F.lit(0)).when(equal, F.col("__cut_words")).when(below, F.col("__size")).otherwise(F.lit(0))
    taken = (F.col("__epochs") * F.col("__size") + part).cast("long").alias("__taken")
    return out.select(*name.values(), "__size", "__source_size", "__target", taken)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, seed: int = 8) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken, with the columns of docs, whatever their names. Documents without words aren't taken."""
    taken = _mixed(docs, id_col, text_col, source_col, weights, most, seed, False)
    times = F.coalesce(F.floor(F.col("__taken") / F.nullif(F.col("__size"), F.lit(0))), F.lit(0)).cast("int")
    return taken.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
