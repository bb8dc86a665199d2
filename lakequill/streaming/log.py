"""The fetch log as a stream: the latest row of each url, and arrivals by window with late data bounded by a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakequill.sources.versioned import Versioned, keep_latest


def read_log(spark: SparkSession, path: str, schema: str, kind: str = "json", files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_a_trigger).load(path)


def latest_to(log: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keep the latest row of each key in a table of versions. A batch rewrites the buckets of its keys only; one that runs again changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        Versioned(batch.sparkSession, path).merge(batch, keys, keep_latest(order, keys), buckets, (checkpoint, number))

    return log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(log: DataFrame, at: str, key: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, key, n): arrivals of each tumbling window; what comes later than the watermark is left out."""
    found = log.withWatermark(at, late).groupBy(F.window(at, window), key).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("window.start").alias("start"), key, "n")


def first_seen(log: DataFrame, at: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: a resumed run's repeats vanish."""
    return log.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
