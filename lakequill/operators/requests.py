"""Many texts through a hosted model that refuses, limits and tires: batches, halving, attempts, waits, a stop, resuming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.sources.versioned import Versioned

#: Of one request: inputs, and bytes of its JSON. Attempts, and seconds that each waits longer than the one before.
INPUTS, BYTES, ATTEMPTS, BACKOFF = 256, 1_000_000, 8, 30.0
STOPPED = "stopped"

Client = Callable[[list[str]], Sequence[Sequence[float]]]


class Refused(Exception):
    """A request that was answered by an error status. wait: seconds until a daily limit is lifted, if that is the reason."""

    def __init__(self, status: int, wait: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.wait = status, wait


class Stopped(Exception):
    """Too many requests, without a word when that ends: nobody goes on."""


def batches(texts: Sequence[str], inputs: int = INPUTS, most_bytes: int = BYTES) -> Iterator[list[str]]:
    """In order, as many as fit; a text that is too large by itself is a batch of its own."""
    held, used = [], 0
    for t in texts:
        cost = len(json.dumps(t).encode()) + 1
        if held and (len(held) >= inputs or used + cost > most_bytes):
            yield held
            held, used = [], 0
        held.append(t)
        used += cost
    if held:
        yield held


def request(client: Client, texts: list[str], pace: Callable[[], None] = lambda: None, attempts: int = ATTEMPTS, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> list[Sequence[float] | None]:
    """The answers in the order of the texts, null for those that could not be had.

    A batch refused as too large (400, 413) is halved, down to single texts, which are given up. A daily limit is waited
    out and isn't an attempt. 429 without a time ends all. Everything else is tried `attempts` times with growing waits.
    """
    tried = 0
    while True:
        pace()
        try:
            found = list(client(texts))
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} answers to {len(texts)} texts")
            return found
        except Refused as e:
            if e.wait is not None:
                sleep(max(60.0, e.wait))
                continue
            if e.status == 429:
                raise Stopped from None
            if e.status in (400, 413):
                if len(texts) == 1:
                    return [None]
                half = len(texts) // 2
                more = partial(request, client, pace=pace, attempts=attempts, backoff=backoff, sleep=sleep)
                return more(texts[:half]) + more(texts[half:])
        except (OSError, KeyError, ValueError):
            pass
        tried += 1
        if tried >= attempts:
            return [None] * len(texts)
        sleep(backoff * tried)


def _run(make: Callable[[], Client], key: str, interval: float, limits: dict, source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, text) to (key, vec, error). A task waits `interval` seconds from one request to the next; once it is told to stop it answers nothing more."""
    client, due, stopped = make(), 0.0, False
    sleep = limits.get("sleep", time.sleep)

    def pace() -> None:
        nonlocal due
        now = time.monotonic()
        if due > now:
            sleep(due - now)
        due = max(due, now) + interval

    for pdf in source:
        vecs, at = [], 0
        for batch in batches(pdf["text"].tolist(), limits["inputs"], limits["bytes"]):
            found: list = [None] * len(batch)
            if not stopped:
                try:
                    found = request(client, batch, pace, limits["attempts"], limits["backoff"], sleep)
                except Stopped:
                    stopped = True
            vecs += [(None, STOPPED if stopped else "failed") if v is None else (_unit(v), None) for v in found]
            at += len(batch)
        yield pd.DataFrame({key: pdf[key], "vec": [v for v, _ in vecs], "error": [e for _, e in vecs]})


def _unit(v: Sequence[float]) -> list[float]:
    x = np.asarray(v, np.float32)
    n = float(np.linalg.norm(x))
    return (x / n if n else x).tolist()


def embed_hosted(
    texts: DataFrame, key: str, column: str, done: Versioned, client: Callable[[], Client], waves: int = 16, tasks: int = 4, rpm: float = 60.0,
    inputs: int = INPUTS, most_bytes: int = BYTES, attempts: int = ATTEMPTS, backoff: float = BACKOFF, **more: object,
) -> dict[str, int]:
    """Vectors of all texts that `done` (key, vec) lacks, merged into it wave by wave: {'asked', 'kept', 'failed', 'waves'}.

    client() runs once in each task and gives a function of a list of texts. The tasks share the pace of rpm requests a
    minute. A refusal for too many requests stops its task at once, and all tasks at the end of their wave: the driver
    starts no further one. Only vectors are kept, so a rerun asks for the rest, and what a lost run had committed stays.
    Rows with a null key or text aren't asked for; of equal keys one is. Vectors have unit length.
    """
    kind = texts.schema[key].dataType.simpleString()
    wanted = texts.where(F.col(key).isNotNull() & F.col(column).isNotNull()).select(key, F.col(column).alias("text")).dropDuplicates([key])
    wave = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(waves))
    limits = {"inputs": inputs, "bytes": most_bytes, "attempts": attempts, "backoff": backoff} | more
    count = {"asked": 0, "kept": 0, "failed": 0, "waves": 0}
    from lakequill.operators.store import materialized

    for i in range(waves):
        fresh = wanted.where(wave == i)
        if done.exists():
            fresh = fresh.join(done.read().select(key), key, "left_anti")
        got = fresh.repartition(tasks, key).mapInPandas(partial(_run, client, key, 60.0 * tasks / rpm, limits), f"{key} {kind}, vec array<float>, error string")
        got = materialized(got, "hosted-wave")
        seen = got.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNull()).alias("ok"), F.count_if(F.col("error") == STOPPED).alias("stopped")).first()
        if seen["ok"]:
            done.merge(got.where("error is null").select(key, "vec"), [key])
        count |= {"asked": count["asked"] + seen["n"], "kept": count["kept"] + seen["ok"], "failed": count["failed"] + seen["n"] - seen["ok"], "waves": i + 1}
        if seen["stopped"]:
            break
    return count
