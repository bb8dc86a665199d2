"""Stretches of words that repeat with a period, found by comparing a text with itself at every shift.

A word occurrence is a number, equal for equal words. The numbers are compared with themselves shifted by each period
up to n / exponent; a stretch of equal places that is long enough is a run. Shifts are taken in blocks, so that one
numpy comparison serves many. Texts up to LONG characters are scanned where they lie; a longer one is scanned by ranges
of shifts on many machines, whose finds meet again by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import column, text_of, written

#: Texts of more characters are dealt out by ranges of shifts.
LONG = 65_536
#: Comparisons of one range, unless that makes more than MOST_RANGES of a document.
RANGE_CELLS, MOST_RANGES = 1 << 28, 256
#: Comparisons of one block of shifts: a byte each.
BLOCK_CELLS = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_ROW, _TEXT = "__row", "__text"


def word_numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    found = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    return found.astype(np.int16) if len(seen) < 1 << 15 else found


def stretches(ids: np.ndarray, low: int, high: int, least: int, exponent: int) -> np.ndarray:
    """(start, length, period) of every maximal stretch of period low..high-1 with length >= max(least, exponent * period)."""
    n, found = len(ids), []
    if n < least or high <= low:
        return np.empty((0, 3), np.int64)
    step = max(1, BLOCK_CELLS // (n + 8))
    wide = -(-n // 8) * 8
    padded = np.full(n + high + 8, -1, ids.dtype)  # no word has number -1
    padded[:n] = ids
    for first in range(low, high, step):
        last = min(first + step, high)
        shifted = np.lib.stride_tricks.sliding_window_view(padded, n)[first:last]
        same = np.zeros((last - first, wide), bool)
        np.equal(shifted, ids, out=same[:, :n])
        periods = np.arange(first, last)
        needed = np.maximum(least - periods, (exponent - 1) * periods)
        for k in np.flatnonzero(_trues(same) >= needed):  # only such shifts can hold a long enough stretch
            edges = np.flatnonzero(np.diff(same[k, :n].view(np.int8), prepend=0, append=0))
            starts, ends = edges[::2], edges[1::2]
            long = ends - starts >= needed[k]
            found.append(np.stack([starts[long], (ends - starts)[long] + periods[k], np.full(long.sum(), periods[k])], axis=1))
    return np.concatenate(found).astype(np.int64) if found else np.empty((0, 3), np.int64)


def _trues(same: np.ndarray) -> np.ndarray:
    """True places of each row; eight bytes are added at once, 255 times before a byte could overflow."""
    eights, total = same.view(np.uint64), 0
    for at in range(0, eights.shape[1], 255):
        part = np.ascontiguousarray(eights[:, at : at + 255].sum(axis=1))
        total = total + part.view(np.uint8).reshape(len(part), 8).sum(axis=1, dtype=np.int64)
    return total


def smallest_periods(found: np.ndarray) -> np.ndarray:
    """Of equal stretches the one of the smallest period, sorted by start, then period: a multiple of a period gives the same stretch again."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[first]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def without_repeats(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(depth[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


def _structs(each: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    whole = np.concatenate(each) if each else np.empty((0, 3), np.int64)
    parts = [pa.array(np.ascontiguousarray(whole[:, i])) for i in range(3)]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_ARROW.value_type)))


def _scan(least: int, exponent: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts: the other columns, runs, kept."""
    for got in source:
        each, kept = [], []
        for text in got.column(_TEXT):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            runs = smallest_periods(stretches(word_numbers(words), 1, len(words) // exponent + 1, least, exponent))
            each.append(runs)
            kept.append(without_repeats(words, runs).decode("utf-8", "surrogatepass"))
        yield _with(got, [_TEXT], each, kept)


def _with(got: pa.RecordBatch, less: list[str], each: list[np.ndarray], kept: list[str]) -> pa.RecordBatch:
    rest = [n for n in got.schema.names if n not in less]
    return pa.RecordBatch.from_arrays([*(got.column(n) for n in rest), _structs(each), pa.array(kept, pa.string())], [*rest, "__runs", "__kept"])


def _scan_range(least: int, exponent: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, low, high) to (row, runs): one range of shifts of one text."""
    for got in source:
        each = [
            stretches(word_numbers(text.as_py().encode("utf-8", "surrogatepass").split()), low.as_py(), high.as_py(), least, exponent)
            for text, low, high in zip(got.column(_TEXT), got.column("low"), got.column("high"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([got.column(_ROW), _structs(each)], [_ROW, "found"])


def _finish(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with all that their ranges found: as _scan gives."""
    for got in source:
        each, kept = [], []
        for text, found in zip(got.column(_TEXT), got.column("found"), strict=True):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            values = found.values
            whole = np.stack([values.field(i).to_numpy() for i in range(3)], axis=1) if values is not None else np.empty((0, 3), np.int64)
            runs = smallest_periods(whole)
            each.append(runs)
            kept.append(without_repeats(words, runs).decode("utf-8", "surrogatepass"))
        yield _with(got, [_TEXT, "found"], each, kept)


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 24, exponent: int = 3, long: int = LONG) -> DataFrame:
    """docs with `runs` and `kept`: the runs of each whole text by start, then period, and its words without the repeats.

    A run is a maximal stretch of words with smallest period q and a length of at least max(least, exponent * q) words
    (exponent 2 or more). Kept is every word that no run holds after its first q words, joined by one space. Words are
    what stands between bytes of ASCII white space. Null and empty texts have no runs and keep ''. Rows with equal ids or
    null ids are rows of their own. Other columns stay as they are; ones called runs or kept give way.

    Nothing is shuffled but texts of over `long` characters: each meets its ranges of shifts on any machine. The scan
    compares all shifts, so its work grows with the square of a text's length, not of the corpus.
    """
    if exponent < 2 or least < 1:
        raise ValueError("exponent must be 2 or more, least 1 or more")
    names = [c for c in docs.columns if c not in ("runs", "kept")]
    rest = [column(docs, c).alias(f"c{i}") for i, c in enumerate(names)]
    held = docs.select(*rest, text_of(column(docs, text_col)).alias(_TEXT))
    size = F.length(_TEXT)
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.drop(_TEXT).schema) + ", " if rest else ""
    result = f"{own}__runs {RUNS}, __kept string"
    near = held.where(size <= long).mapInArrow(partial(_scan, least, exponent), result)

    far = written(held.where(size > long).withColumn(_ROW, F.monotonically_increasing_id()), "long-texts")
    words = F.regexp_count(_TEXT, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    most = F.expr(f"n div {exponent}")  # shifts of a text
    step = F.greatest(F.lit(1), F.expr(f"cast(ceil(n div {exponent} / least({MOST_RANGES}, ceil(n * (n div {exponent}) / {RANGE_CELLS}))) as bigint)"))
    ranges = far.select(_ROW, _TEXT, words.alias("n")).where(most >= 1).select(_ROW, _TEXT, most.alias("most"), step.alias("step"))
    ranges = ranges.select(_ROW, _TEXT, "most", "step", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"), F.col("step"))).alias("low"))
    ranges = ranges.select(_ROW, _TEXT, "low", F.least(F.col("low") + F.col("step"), F.col("most") + 1).alias("high")).repartition(_ROW, "low")
    found = ranges.mapInArrow(partial(_scan_range, least, exponent), f"{_ROW} bigint, found {RUNS}")
    found = found.groupBy(_ROW).agg(F.flatten(F.collect_list("found")).alias("found"))  # a text of n words has fewer than n runs
    joined = far.join(found, _ROW, "left").withColumn("found", F.coalesce("found", F.array().cast(RUNS))).drop(_ROW)
    both = near.unionByName(joined.mapInArrow(_finish, result))
    return both.select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)), F.col("__runs").alias("runs"), F.col("__kept").alias("kept"))


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period; null without runs."""
    ratio = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(ratio(x, best), x).otherwise(best))


def planted(words: Column, start: Column, period: Column) -> Column:
    """words with each word i >= start replaced by word start + (i - start) % period."""
    tail = F.size(words) - start
    unit = F.slice(words, start + 1, period)
    return F.concat(F.slice(words, F.lit(1), start), F.slice(F.flatten(F.array_repeat(unit, F.ceil(tail / period).cast("int"))), F.lit(1), tail))
