"""Incremental tables: carry-over, caches, done sets, upserts, latest rows, manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.functions.text import represent


def carry_over(new: DataFrame, old: DataFrame, carried: Sequence[str]) -> DataFrame:
    """new chunks with the carried columns of the old chunk of the same size, page and embedded text; of several the last (pos) wins; null if there is none."""
    key = represent(F.col("title"), F.col("breadcrumb"), F.col("text"))
    last = old.withColumn("key", key).groupBy("size", "page_id", "key").agg(F.max_by(F.struct(*carried), "pos").alias("kept"))
    return new.withColumn("key", key).join(last, ["size", "page_id", "key"], "left").drop("key").select("*", *(F.col(f"kept.{c}").alias(c) for c in carried)).drop("kept")


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct wanted rows that the cache hasn't: each is computed once, however often it is asked for."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def cached(wanted: DataFrame, cache: DataFrame, computed: DataFrame, key: str = "key") -> DataFrame:
    """wanted with the value of the cache or of what was computed; row order is a column's matter (ordinal)."""
    return wanted.join(cache.select(key, "value").unionByName(computed.select(key, "value")), key, "left")


def without_done(rows: DataFrame, done: DataFrame, keys: Sequence[str], error: str | None = "error") -> DataFrame:
    """Rows that aren't done; a done row with an error counts as open."""
    finished = done.where(F.col(error).isNull()) if error else done
    return rows.join(finished.select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], rule: str = "replace", error: str = "error") -> DataFrame:
    """old and new as one table with a row for each key.

    replace: the new row wins. ignore: the old one. replace_failed: the new one only where the old has an error.
    """
    first = {"replace": F.lit(0), "ignore": F.lit(2), "replace_failed": F.when(F.col(error).isNull(), F.lit(0)).otherwise(F.lit(2))}
    order = F.when(F.col("__new"), F.lit(1)).otherwise(F.lit(2) if rule == "replace" else F.lit(0) if rule == "ignore" else first["replace_failed"])
    both = old.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True)))
    ranked = both.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where("__at = 1").drop("__at", "__new")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key; aggregated before the shuffle, so a key that is written often costs one row a task."""
    others = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x"))
    return best.select(*keys, "x.*")


def manifest(rows: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """(key, value, rows, ok_rows): the whole table (key 'all') and each value of each key, in one pass of grouping sets; null values are skipped."""
    sets = rows.select(*(F.col(k).cast("string").alias(k) for k in keys), ok.alias("__ok")).groupingSets([[], *([F.col(k)] for k in keys)], *(F.col(k) for k in keys))
    flags = [F.grouping(k).alias(f"__{k}") for k in keys]
    counted = sets.agg(F.count(F.lit(1)).alias("rows"), F.count_if("__ok").alias("ok_rows"), *flags)
    name = F.lit("all")
    value = F.lit("")
    for k in keys:
        name = F.when(F.col(f"__{k}") == 0, F.lit(k)).otherwise(name)
        value = F.when(F.col(f"__{k}") == 0, F.col(k)).otherwise(value)
    return counted.select(name.alias("key"), value.alias("value"), "rows", "ok_rows").where("value is not null")


def schema_union(tables: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns; absent is null, structs, maps and arrays of structs become JSON text."""
    out = None
    for t in tables:
        flat = t.select(*(F.to_json(c).alias(c) if kind.startswith(("struct", "map", "array<struct", "array<map")) else F.col(c) for c, kind in t.dtypes))
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    return out


def greedy_batches(rows: DataFrame, key: str, order: str, cost: Column, most: int = 256, most_cost: int = 1_000_000) -> DataFrame:
    """rows with batch: in order within the key, a new one when it would hold more rows or more cost.

    Keys, order and costs alone are sorted and walked once, in a stream; nothing is held but the open batch's two sums.
    (key, order) is unique.
    """
    kinds = dict(rows.dtypes)
    narrow = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), cost.cast("long").alias("c")).repartition("k").sortWithinPartitions("k", "o")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, held, used, batch = object(), 0, 0, 0
        for got in source:
            out = []
            for k, c in zip(got.column(0).to_pylist(), got.column(2).to_pylist()):
                if k != open_key:
                    open_key, held, used, batch = k, 0, 0, 0
                elif held >= most or used + c > most_cost:
                    held, used, batch = 0, 0, batch + 1
                held, used = held + 1, used + c
                out.append(batch)
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(out, pa.int64())], ["k", "o", "batch"])

    found = narrow.mapInArrow(run, f"k {kinds[key]}, o {kinds[order]}, batch long")
    return rows.join(found, F.col(key).eqNullSafe(F.col("k")) & (F.col(order) == F.col("o"))).drop("k", "o")


def placed(rows: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """rows with place, from 0, in the order of the columns. Ranges are numbered apart and their counts give each its first number, so no task sorts all rows."""
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = materialized(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), nth.alias("__i")), label)
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row for each partition
    return ranged.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__before") + F.col("__i")).alias("place"))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder that the cluster names; in local mode, where none is named, in a local one."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakequill-")
    return f"{folder.rstrip('/')}/lakequill/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filled(rows: DataFrame, notes: DataFrame, column: str, key: str = "id") -> DataFrame:
    """rows whose column is the note of their key, where there is one; notes (key, text) of keys that are gone are skipped. A present note wins, also an empty one."""
    noted = notes.select(F.col(key).alias("__key"), F.col("text").alias("__note"), F.lit(True).alias("__noted"))
    joined = rows.join(noted, F.col(key) == F.col("__key"), "left")
    return joined.withColumn(column, F.when(F.col("__noted"), F.col("__note")).otherwise(F.col(column))).select(*rows.columns)


def done_everywhere(tasks: Sequence[DataFrame], key: str = "id") -> DataFrame:
    """The keys that every task's done set holds."""
    found = tasks[0].select(key).distinct()
    for other in tasks[1:]:
        found = found.join(other.select(key), key, "left_semi")
    return found


def numbered_batches(rows: DataFrame, taken: DataFrame, key: str, size: int, first: int = 0) -> DataFrame:
    """(key, batch): rows not yet taken, `size` to a batch in key order, numbered on from `first`.

    Keys are range partitioned and numbered within each partition; the partitions' counts give each its first number, so
    no task sorts all keys.
    """
    fresh = rows.select(key).join(taken.select(key), key, "left_anti").distinct()
    return placed(fresh, [key], "batches").select(key, (F.floor(F.col("place") / size) + first).cast("long").alias("batch"))
