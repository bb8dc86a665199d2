"""Arrays of floats as vectors. For many dot products use operators.dense, which works in blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    n = norm(v)
    return F.transform(v, lambda x: x.cast("double") / F.nullif(n, F.lit(0.0)))


def shortened(v: Column, dims: int) -> Column:
    """The first dims components, of unit length again."""
    return unit(F.slice(v, 1, dims))


def missing(v: Column) -> Column:
    """Null, empty, or NaN in the first or last component."""
    return v.isNull() | (F.size(v) == 0) | F.isnan(F.get(v, F.lit(0))) | F.isnan(F.element_at(v, -1))
