"""Places: range joins on a grid, geographic reranking, gazetteer lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.functions.geo import decay_of, geo_score, haversine
from lakequill.functions.text import words
from lakequill.operators.ranking import min_max, top_k

KM_A_DEGREE = 111.0


def within(anchors: DataFrame, places: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """(anchor_id, place_id, km): places at most so far from an anchor, the anchor itself left out; km rounded to digits, if given.

    anchors (anchor_id, lat, lon), places (place_id, lat, lon). Distinct points are cut to grid cells of the distance's
    height, those of anchors looking into the cells around them; only points of neighbouring cells meet, by an equi-join.
    The ids join their points last, so that a distance is computed once, however many rows lie at its two ends.
    """
    cell = km / KM_A_DEGREE
    rows = F.floor(F.col("lat") / cell).cast("long")
    # A degree of longitude shrinks towards the poles: the width in cells follows the row, the same on both sides.
    width = lambda row: F.greatest(F.cos(F.radians(F.least(F.lit(89.0), F.greatest(F.abs(row * cell), F.abs((row + 1) * cell))))), F.lit(0.017))
    p = places.select("lat", "lon").distinct().withColumn("row", rows).withColumn("col", F.floor(F.col("lon") * width(F.col("row")) / cell).cast("long"))
    p = p.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), "row", "col")
    a = anchors.select("lat", "lon").distinct().withColumn("row", F.explode(F.sequence(rows - 1, rows + 1)))
    at = F.col("lon") * width(F.col("row")) / cell
    reach = F.lit(1.2)  # of the row's own width, so that cells at the row's narrow side are seen too
    a = a.withColumn("col", F.explode(F.sequence(F.floor(at - reach).cast("long"), F.floor(at + reach).cast("long"))))
    near = a.join(p, ["row", "col"]).withColumn("km", haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).where(F.col("km") <= km)
    near = near.select("lat", "lon", "plat", "plon", F.round("km", digits).alias("km") if digits is not None else F.col("km"))
    found = near.join(anchors.select("anchor_id", "lat", "lon"), ["lat", "lon"]).select("anchor_id", "plat", "plon", "km")
    found = found.repartition(int(places.sparkSession.conf.get("spark.sql.shuffle.partitions")), "anchor_id")  # few rows that become many: a number keeps them apart
    ends = places.select("place_id", F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    return found.join(ends, ["plat", "plon"]).where(F.col("anchor_id") != F.col("place_id")).select("anchor_id", "place_id", "km")


def geo_rerank(ranking: DataFrame, places: DataFrame, points: DataFrame, limit: int = 10, weight: float = 0.3, overfetch: int = 4) -> DataFrame:
    """Mix nearness into scoped queries; others keep their scores and order.

    ranking (query_id, rank, chunk_id, score), places (query_id, lat, lon, granularity), points (chunk_id, lat, lon).
    A query whose granularity has no decay isn't scoped. Scoped ones look at limit * overfetch candidates, their text
    scores min-max scaled (all 0 where they are equal).
    """
    p = places.select("query_id", F.col("lat").alias("qlat"), F.col("lon").alias("qlon"), decay_of(F.col("granularity")).alias("decay")).where("decay is not null")
    joined = ranking.join(p, "query_id", "left").where(F.when(F.col("decay").isNull(), F.col("rank") <= limit).otherwise(F.col("rank") <= limit * overfetch))
    scoped = joined.where("decay is not null").join(points.select("chunk_id", "lat", "lon"), "chunk_id", "left")
    km = haversine(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon"))
    scored = scoped.withColumn("text_score", min_max(F.col("score"), "query_id", flat=0.0)).withColumn("score", geo_score(F.col("text_score"), km, F.col("decay"), weight))
    mixed = top_k(scored.select("query_id", "chunk_id", "score", F.col("rank").alias("before")), limit, "before")
    return mixed.unionByName(joined.where("decay is null").select("query_id", "rank", "chunk_id", "score"))


def resolve(named: DataFrame, gazetteer: DataFrame, hits: int = 5) -> DataFrame:
    """(query_id, place_id, lat, lon): of the gazetteer's first hits whose label shares a word with the named place, the first that has a point and is no person.

    named (query_id, place), gazetteer (place, position, place_id, label, lat, lon, is_person). Queries without a fitting hit are left out.
    """
    near = named.join(gazetteer.where(F.col("position") <= hits), "place")
    ok = near.where(F.arrays_overlap(words(F.col("place")), words(F.col("label"))) & F.col("lat").isNotNull() & ~F.coalesce("is_person", F.lit(False)))
    best = ok.groupBy("query_id").agg(F.min_by(F.struct("place_id", "lat", "lon"), "position").alias("x"))
    return best.select("query_id", "x.*")
