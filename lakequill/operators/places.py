"""Places of queries with a cache of three states: a place, known to have none, and not known because a lookup failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.text import place_key
from lakequill.operators.store import materialized
from lakequill.sources.versioned import Versioned

#: Of a lookup's result and of the cache: a null lat is a query that names no place.
PLACE = "lat double, lon double, decay_km double"


def places_of(queries: DataFrame, cache: Versioned, lookup: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_id, lat, lon, decay_km, state) of queries (query_id, text); state is place, none or failed.

    lookup gets (key, text), each key that the cache lacks once, and gives (key, lat, lon, decay_km) for what it found
    out, with nulls where the query names no place; keys it leaves out have failed and are asked again the next time. What
    it found is merged into the cache, bucket by bucket. A null text has the state none and isn't looked up.
    """
    asked = queries.select("query_id", place_key(F.col("text")).alias("key"), "text")
    keys = asked.where("key is not null").groupBy("key").agg(F.min("text").alias("text"))
    known = cache.read() if cache.exists() else queries.sparkSession.createDataFrame([], f"key string, {PLACE}")
    misses = materialized(keys.join(known.select("key"), "key", "left_anti"), "place-misses")
    if not misses.isEmpty():
        cache.merge(lookup(misses).select("key", *(F.col(c).cast("double").alias(c) for c in ("lat", "lon", "decay_km"))).dropDuplicates(["key"]), ["key"])
    now = (cache.read() if cache.exists() else known).withColumn("there", F.lit(True))
    state = F.when(F.col("key").isNull(), "none").when(F.col("there").isNull(), "failed").when(F.col("lat").isNull(), "none").otherwise("place")
    return asked.join(now, "key", "left").select("query_id", "lat", "lon", "decay_km", state.alias("state"))
