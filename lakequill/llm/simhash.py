"""SimHash near-duplicates by the generalised pigeonhole principle.

Equal fingerprints collapse first. The 64 bits of the others are grouped into partitions of correlated bits, and each
partition gets its own threshold t (or is left out, t = -1) so that the thresholds plus one sum to the distance plus
one: two fingerprints within the distance then agree within t in at least one partition. A dynamic programme over all
numbers of partitions picks the thresholds with the least estimated probes and candidates. Fingerprints and their
probes meet by partition value, are verified there on all 64 bits, and leave links enough to connect what is linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import column, small_or_not, text_of, written
from lakequill.llm.components import components

BITS = 64
SEED = 42
#: Relative costs of moving a probe through the shuffle and of verifying a candidate.
PROBE, CANDIDATE = 1.0, 0.01
#: A partition value with more fingerprints is dealt on by the other bits before it is verified.
CROWDED = 20_000
_POPULAR = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (256 * np.arange(8)).astype(np.int64)


def simhash(text: bytes, words_a_shingle: int = 4) -> int:
    """Of UTF-8 bytes: A-Z lower-cased, words between ASCII white space, XXH64 of space-joined shingles, majority of each bit."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= words_a_shingle:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-words_a_shingle]]).tolist()
    counts, low = np.zeros(BITS, np.int64), 0
    stops = (ends[words_a_shingle - 1 :] - 1).tolist()
    n = len(stops)
    while low < n:
        part = np.array([h(joined[s:e], SEED) for s, e in zip(starts[low : low + 65536], stops[low : low + 65536])], np.uint64)
        table = np.bincount((part.view(np.uint8).reshape(-1, 8) + _OFFSETS).ravel(), minlength=2048).reshape(8, 256)
        counts += (table @ _POPULAR).ravel()
        low += 65536
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _hashes(words: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            fps = np.array([simhash(t or b"", words) for t in got.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return run


def simhashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 4) -> DataFrame:
    """(id, fp) for each row of docs; a text without words has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(column(docs, id_col).alias("id"), text_of(column(docs, text_col)).alias("text")).mapInArrow(_hashes(words_a_shingle), f"id {kind}, fp long")


class Part(NamedTuple):
    bits: tuple[int, ...]
    threshold: int


def _bit_counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for got in source:
        x = np.unpackbits(got.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
        for low in range(0, len(x), 65536):
            total += np.rint(x[low : low + 65536].T @ x[low : low + 65536]).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(BITS), BITS)), pa.array(np.tile(np.arange(BITS), BITS)), pa.array(total.ravel())], ["i", "j", "n"])


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j both set, over all of them; 4,096 sums come to the driver."""
    both = np.zeros((BITS, BITS), np.int64)
    for i, j, n in fps.select("fp").mapInArrow(_bit_counts, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():
        both[i, j] = n
    return fps.count(), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[tuple[int, ...]]:
    """Bits in groups of nearly equal size, each grown from the bit most correlated with the rest by the one most correlated with the group."""
    p = np.diag(both) / max(1, n)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(1, n) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        out.append(tuple(sorted(group)))
    return out


def within(p: np.ndarray, bits: Sequence[int], most: int) -> list[float]:
    """Estimated chance that two fingerprints differ in at most t of the bits, for t from 0 to most."""
    dist = np.zeros(most + 1)
    dist[0] = 1.0
    for b in bits:
        q = 2 * p[b] * (1 - p[b])
        dist = dist * (1 - q) + np.concatenate([[0], dist[:-1]]) * q
    return np.cumsum(dist).tolist()


def variants(width: int, t: int) -> int:
    return sum(comb(width, k) for k in range(t + 1))


def allocate(n: int, both: np.ndarray, distance: int, most_parts: int = 8) -> list[Part]:
    """The cheapest partitions and thresholds by dynamic programming; thresholds plus one sum to the distance plus one."""
    p = np.diag(both) / max(1, n)
    best: tuple[float, list[Part]] | None = None
    for parts in range(1, most_parts + 1):
        groups = grouped_bits(n, both, parts)
        costs = []
        for g in groups:
            near = within(p, g, distance)
            costs.append([0.0] + [n * (PROBE * (variants(len(g), t) + (t > 0)) + CANDIDATE * n * near[t]) if variants(len(g), min(t, 3)) < 20_000 else np.inf for t in range(distance + 1)])
        table: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for cost in costs:
            new: dict[int, tuple[float, tuple[int, ...]]] = {}
            for used, (c, ts) in table.items():
                for t1, extra in enumerate(cost):
                    if used + t1 <= distance + 1 and (used + t1 not in new or c + extra < new[used + t1][0]):
                        new[used + t1] = (c + extra, (*ts, t1 - 1))
            table = new
        if distance + 1 in table and (best is None or table[distance + 1][0] < best[0]):
            best = (table[distance + 1][0], [Part(g, t) for g, t in zip(groups, table[distance + 1][1], strict=True) if t >= 0])
    return best[1]


def gathered(fps: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """The values of the bits, packed."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


BOTH, INDEXED, PROBING = 0, 1, 2
#: Comparisons that are made at once.
SMALL = 1 << 18


def _mixed(part: int, value: np.ndarray) -> np.ndarray:
    h = value + np.uint64((part + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))).view(np.int64)


def _probes(parts: list[Part]) -> Callable:
    """Fingerprints to (key, fp, role). The key stands for a partition and a value of its bits; mixing is one to one within a partition."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            every = got.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for low in range(0, len(every), 4096):
                fps = every[low : low + 4096]
                for i, part in enumerate(parts):
                    value = gathered(fps, part.bits)
                    todo = [(value, BOTH if part.threshold == 0 else INDEXED)]
                    if part.threshold:
                        masks = [sum(1 << b for b in flips) for k in range(part.threshold + 1) for flips in combinations(range(len(part.bits)), k)]
                        todo += [(value ^ np.uint64(m), PROBING) for m in masks]
                    for v, role in todo:
                        yield pa.RecordBatch.from_arrays([pa.array(_mixed(i, v)), pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), role, np.int8))], ["key", "fp", "role"])

    return run


class Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def linked(fps: np.ndarray, roles: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Links within one group that connect whatever is within the distance; fewer than its fingerprints, however dense it is.

    A large group goes on by the exact values of distance + 1 blocks of all bits, of which a pair within the distance
    shares one: only fingerprints that do are compared.
    """
    own = fps[roles != PROBING]
    ask = fps[roles != INDEXED]
    union = Union()
    if len(own) * len(ask) <= SMALL:
        yield from _near(ask, own, distance, union)
        return
    # Probes are fingerprints too and links are verified on all bits, so all points of the group count alike.
    every = np.unique(np.concatenate([own, ask]))
    width = -(-BITS // (distance + 1))
    for k in range(distance + 1):
        value = (every >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
        order = np.argsort(value, kind="stable")
        cut = np.concatenate([[0], np.flatnonzero(np.diff(value[order])) + 1, [len(every)]])
        for i in np.flatnonzero(np.diff(cut) > 1).tolist():
            part = every[order[cut[i] : cut[i + 1]]]
            if len(part) ** 2 <= SMALL:
                yield from _near(part, part, distance, union)
            else:
                yield from _walked(part, distance, union)


def _near(ask: np.ndarray, own: np.ndarray, distance: int, union: Union) -> Iterator[tuple[int, int]]:
    """All pairs compared; those that the union doesn't connect yet."""
    a, b = np.nonzero(np.bitwise_count(ask[:, None] ^ own[None, :]) <= distance)
    for x, y in zip(ask[a].tolist(), own[b].tolist()):
        if x != y and union.join(x, y):
            yield x, y


def _walked(left: np.ndarray, distance: int, union: Union) -> Iterator[tuple[int, int]]:
    """Breadth first: what has been reached isn't compared again, so a dense group costs a few passes."""
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ np.uint64(x)) <= distance
            for y in left[near].tolist():
                if union.join(x, y):
                    yield x, y
                front.append(y)
            left = left[~near]


def _verify(distance: int) -> Callable:
    """Rows sorted by key to links."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups(keys: np.ndarray, fps: np.ndarray, roles: np.ndarray) -> list[tuple[int, int]]:
            cut = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            many = np.flatnonzero(np.diff(cut) > 1)
            return [e for k in many.tolist() for e in linked(fps[cut[k] : cut[k + 1]], roles[cut[k] : cut[k + 1]], distance)]

        def out(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

        pending: list[tuple[np.ndarray, ...]] = []
        for got in source:
            now = (got.column(0).to_numpy(zero_copy_only=False), got.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), got.column(2).to_numpy(zero_copy_only=False))
            if not len(now[0]):
                continue
            if pending and now[0][0] == now[0][-1] == pending[-1][0][-1]:
                pending.append(now)  # the same group goes on through all of this batch
                continue
            held = tuple(np.concatenate(x) for x in zip(*pending, now, strict=True))
            other = np.flatnonzero(held[0] != held[0][-1])
            last = int(other[-1]) + 1 if len(other) else 0  # the last group may go on in the next batch
            if edges := groups(*(x[:last] for x in held)):
                yield out(edges)
            pending = [tuple(x[last:] for x in held)]
        if pending:
            if edges := groups(*(np.concatenate(x) for x in zip(*pending, strict=True))):
                yield out(edges)

    return run


def links(fps: DataFrame, distance: int = 4, crowded: int = CROWDED) -> DataFrame:
    """(a, b) between distinct fingerprints: every pair within the distance is connected, no pair beyond it is linked."""
    n, both = bit_statistics(fps)
    parts = allocate(n, both, distance)
    probes = fps.select("fp").mapInArrow(_probes(parts), "key long, fp long, role byte")
    hot = written(probes.where(F.col("role") != PROBING).groupBy("key").count().where(F.col("count") > crowded).select(F.col("key").alias("hot")), "simhash-hot")
    many = hot.count()
    if many:
        # Those groups go on by exact values of distance + 1 blocks of all bits: a pair within the distance shares one.
        placed = probes.join(small_or_not(hot, many), F.col("key") == F.col("hot"), "left")
        width = -(-BITS // (distance + 1))
        block = [F.shiftrightunsigned(F.col("fp"), k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in range(distance + 1)]
        spread = F.when(F.col("hot").isNull(), F.array(F.col("key"))).otherwise(F.array(*(F.xxhash64(F.col("key"), F.lit(k), b) for k, b in enumerate(block))))
        probes = placed.select(F.explode(spread).alias("key"), "fp", "role")
    return probes.repartition(F.col("key")).sortWithinPartitions("key").mapInArrow(_verify(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, words_a_shingle: int = 4) -> DataFrame:
    """One row for each row of docs: id, fp (long), component_id, the smallest id reachable over links.

    Fingerprints link at `distance` or fewer differing bits; a text without words (or null) has fingerprint 0 and links
    like any other. Rows whose ids are all null in a component have a null component. An empty table gives an empty result.
    """
    fps = written(simhashes(docs, id_col, text_col, words_a_shingle), "simhash")
    distinct = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    edges = written(links(distinct, distance).distinct(), "simhash-links")
    label = components(edges)
    joined = distinct.join(label, distinct["fp"] == label["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    of = joined.join(least, "root").select(F.col("fp").alias("__fp"), "component_id")
    return fps.join(of, F.col("fp") == F.col("__fp")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def group_heads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose id is the smallest of their near-duplicate group, with all their columns; rows without an id can't be told apart and stay."""
    gone = near_duplicates(docs, id_col, text_col, **options).where(F.col(id_col).isNotNull() & (F.col(id_col) != F.col("component_id"))).select(F.col(id_col).alias("__id")).distinct()
    gone = written(gone, "simhash-gone")
    return docs.join(small_or_not(gone, gone.count()), column(docs, id_col) == gone["__id"], "left_anti")
