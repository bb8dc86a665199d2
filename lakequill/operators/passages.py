"""Which texts hold which passages: blocks of texts meet blocks of passages and are scanned once.

A passage is known by one window of bytes, the one that fewest passages of its block have. Prefix sums of a polynomial
over a slice of the texts give the hash of every window, and of the whole passage around one that is known, in one step
each; what agrees is compared byte by byte. So the work is that of reading, however common a passage's parts are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators.sizes import BROADCAST_ROWS

#: Of a block: bytes of texts, passages and their bytes.
TEXT_BYTES, PASSAGES, PASSAGE_BYTES = 4 << 20, 4_096, 1 << 20
#: Places that are looked at at once.
SLICE = 1 << 18
#: Bytes of a window; a passage has the largest that fits in it.
WINDOWS = (32, 8, 2, 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_BYTES = 64 << 20


def _packed(most: int, most_bytes: int, schema: pa.Schema) -> Callable:
    """Rows (id, text) to blocks: ids, data, ends; rows without text are left out."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            got = got.filter(pc.is_valid(got.column(1)))
            sizes = pc.binary_length(got.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            low = 0
            while low < got.num_rows:
                before = ends[low - 1] if low else 0
                high = max(low + 1, min(low + most, int(np.searchsorted(ends, before + most_bytes, side="right"))))
                ids = pa.concat_arrays([got.column(0).slice(low, high - low)])
                data = b"".join(got.column(1).slice(low, high - low).cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([data], pa.binary()), pa.array([(ends[low:high] - before).tobytes()], pa.binary())], schema=schema)
                low = high

    return run


def _blocks(rows: DataFrame, most: int, most_bytes: int, prefix: str = "") -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    result = f"{prefix}ids array<{rows.schema['id'].dataType.simpleString()}>, {prefix}data binary, {prefix}ends binary"
    return rows.select("id", "text").mapInArrow(_packed(most, most_bytes, to_arrow_schema(rows.sparkSession.createDataFrame([], result).schema)), result)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, BASE, np.uint64)]))


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Of each prefix; the hash of a stretch is the difference of two, times the power that brings its start to one place."""
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)])])


def occurrences(data: bytes, ends: np.ndarray, passages: list[bytes]) -> Iterator[tuple[int, int]]:
    """(text, passage), each once: of the texts, concatenated, that end at ends, those that hold the passage."""
    ends = ends.astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    yield from ((t, p) for p, quote in enumerate(passages) if not quote for t in range(len(ends)))
    asked = [p for p, quote in enumerate(passages) if quote]
    if not asked or not data:
        return
    longest = max(len(passages[p]) for p in asked)
    powers = _powers(SLICE + 2 * longest)
    top = len(powers) - 1  # where hashes are compared
    buffer = np.frombuffer(data, np.uint8)
    # By size of window: of each passage the window's hash and place, and the hash of the whole.
    tables = []
    with np.errstate(over="ignore"):
        hashes, kinds = {}, {p: next(w for w in WINDOWS if w <= len(passages[p])) for p in asked}
        whole = np.zeros(len(passages), np.uint64)
        sharing: Counter = Counter()
        for p in asked:
            sums, w = _sums(np.frombuffer(passages[p], np.uint8), powers), kinds[p]
            n = len(passages[p])
            hashes[p] = (sums[w:] - sums[:-w]) * powers[top - np.arange(n - w + 1)]
            whole[p] = sums[-1] * powers[top]
            sharing.update((w, h) for h in set(hashes[p].tolist()))
        for w in sorted(set(kinds.values())):
            mine = [p for p in asked if kinds[p] == w]
            at = [min(range(len(hashes[p])), key=lambda i, p=p, w=w: sharing[w, int(hashes[p][i])]) for p in mine]
            keys = np.array([hashes[p][i] for p, i in zip(mine, at, strict=True)], np.uint64)
            order = np.argsort(keys, kind="stable")
            tables.append((w, keys[order], np.array(mine)[order], np.array(at)[order]))
        lengths = np.array([len(x) for x in passages])
        shift = np.uint64(44)
        found: set[int] = set()
        for low in range(0, len(buffer), SLICE):
            part = buffer[low : low + SLICE + longest]
            sums = _sums(part, powers)
            for w, keys, mine, at in tables:
                if len(part) < w:
                    continue
                h = (sums[w:] - sums[:-w]) * powers[top - np.arange(len(part) - w + 1)]
                known = np.zeros(1 << 20, bool)
                known[keys >> shift] = True
                place = np.flatnonzero(known[h >> shift])
                first, last = (np.searchsorted(keys, h[place], side=side) for side in ("left", "right"))
                times = last - first
                place, nth = np.repeat(place, times), np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
                begin, p = place - at[nth], mine[nth]
                end = begin + lengths[p]
                use = (begin >= 0) & (begin < SLICE) & (end <= len(part))
                begin, end, p = begin[use], end[use], p[use]
                use = (sums[end] - sums[begin]) * powers[top - begin] == whole[p]
                begin, end, p = begin[use] + low, end[use] + low, p[use]
                text = np.searchsorted(ends, begin, side="right")
                use = end <= ends[text]
                pairs, one = np.unique(text[use] * len(passages) + p[use], return_index=True)
                for pair, b in zip(pairs.tolist(), begin[use][one].tolist(), strict=True):
                    t, q = divmod(pair, len(passages))
                    if pair not in found and (data[b : b + lengths[q]] == passages[q] or data.find(passages[q], int(starts[t]), int(ends[t])) >= 0):
                        found.add(pair)
    yield from (divmod(pair, len(passages)) for pair in sorted(found))


def _holding(schema: pa.Schema) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            for i in range(got.num_rows):
                row = {name: got.column(name)[i] for name in got.schema.names}
                cut = np.frombuffer(row["q_ends"].as_py(), np.int64)
                asked = row["q_data"].as_py()
                passages = [asked[a:b] for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
                pairs = list(occurrences(row["data"].as_py(), np.frombuffer(row["ends"].as_py(), np.int64), passages))
                t, p = (pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([row["q_ids"].values.take(p), row["ids"].values.take(t)], schema=schema)

    return run


def holding(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """(passage_id, text_id) of passages (id, text), distinct ones, and texts (id, text): every text that holds the passage, sign by sign."""
    from pyspark.sql.pandas.types import to_arrow_schema

    have = passages.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    asked = _blocks(passages.repartition(1 + max(have["n"] // (8 * PASSAGES), have["bytes"] // (8 * PASSAGE_BYTES))), PASSAGES, PASSAGE_BYTES, "q_")
    held = _blocks(texts, 10_000, TEXT_BYTES)
    few = have["n"] <= BROADCAST_ROWS and have["bytes"] <= BROADCAST_BYTES
    met = held.crossJoin(F.broadcast(asked)) if few else held.hint("shuffle_replicate_nl").crossJoin(asked)
    result = f"passage_id {passages.schema['id'].dataType.simpleString()}, text_id {texts.schema['id'].dataType.simpleString()}"
    return met.mapInArrow(_holding(to_arrow_schema(passages.sparkSession.createDataFrame([], result).schema)), result)
