"""Place names to places. A table serves jobs; the online client only fills it and is behind a function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame

from lakequill.operators.store import cache_misses

AT_ONCE = 50


def in_batches(ids: Sequence[str], size: int = AT_ONCE) -> Iterator[Sequence[str]]:
    for low in range(0, len(ids), size):
        yield ids[low : low + size]


def patient(request: Callable[[], tuple[int, dict]], tries: int = 5, pause: float = 5.0, wait: Callable[[float], None] = time.sleep) -> dict:
    """The answer of request() -> (status, body); 429 and 5xx wait and try again."""
    for i in range(tries):
        status, body = request()
        if status < 400:
            return body
        if status != 429 and status < 500:
            break
        if i + 1 < tries:
            wait(pause)
    raise RuntimeError(f"request failed with status {status}")


def unanswered(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Queries that no cached answer (a null one is an answer) covers."""
    return cache_misses(queries, cache)
