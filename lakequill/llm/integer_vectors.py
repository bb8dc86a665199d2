"""Vectors of small integers: what the clustering and the exact search compare."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components are cut to +-MOST, so that sums over MOST_DIMS squared differences or products stay within 64 bits.
MOST, MOST_DIMS = 1 << 24, 8_192


def usable(vec: Column) -> Column:
    """False for a null vector and for one with a null or non-finite component."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def scaled(vec: Column, factor: int) -> Column:
    """floor(factor * x) of each component as int; beyond +-MOST it is +-MOST."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * factor))).cast("int"))


def matrix(lists: pa.Array, kind: type = np.int64) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(kind, copy=False).reshape(len(lists), -1)
