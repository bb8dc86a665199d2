"""Distances and their decay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_DIAMETER_KM = 12742.0
#: Kilometres at which the weight of a place has fallen to 1/e; other granularities aren't scoped.
DECAY_KM = {"site": 10.0, "town": 10.0, "region": 50.0}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return EARTH_DIAMETER_KM * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would skip a null


def decay_of(granularity: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, km in DECAY_KM.items():
        out = F.when(granularity == name, F.lit(km)).otherwise(out)
    return out


def geo_score(text_score: Column, km: Column, decay_km: Column, weight: float = 0.3) -> Column:
    """Text and nearness; a chunk without a point is neutral, as if it stood at the place."""
    return (1 - weight) * text_score + weight * F.coalesce(F.exp(-km / decay_km), F.lit(1.0))
