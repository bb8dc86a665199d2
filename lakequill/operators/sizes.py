"""Broadcast only what has been counted; deal out what is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SPREAD_BYTES = 16 << 20


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows (counted up to one more), else as it is."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the cores if it is estimated at less than SPREAD_BYTES for each, else as it is: a small file of one row group is one task, however many cores wait."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files, without listing them here
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df
