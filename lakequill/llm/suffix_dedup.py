"""Repeated passages by a partitioned suffix sort with bucket-pointer refinement.

Every start of a 400-byte string is assigned to an anchor that depends on the string alone: its smallest 128-gram hash.
Equal strings have equal anchors, so starts whose anchor occurs once are unique and leave at once, and the others meet
by anchor, where their suffixes are sorted: initial buckets by 8-grams, each refined by sorting on the bucket identifiers
of a later offset. New identifiers are written at once, so buckets that come later in the same pass already sort on
them and gain all the depth they stand for. Neighbours in the suffix order are then compared byte by byte. Runs of
starts with one anchor whose whole surroundings are equal count once. An anchor with very many different surroundings
(a common line, say) is dealt out further by all that the strings of a few neighbouring starts share, and what stays
crowded by fewer starts, down to one, where the group is one string: no group that is sorted grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import BROADCAST_ROWS, batches, column, small_or_not, text_of, written

LENGTH = 400
ANCHOR = 128
GRAM = 8
#: A group with more different surroundings is dealt out further, by so many starts at a time; one start leaves one string.
CROWDED = 512
PIECES_OF = (32, 4, 1)
#: Positions that are sorted together, and one more group at most, which holds CROWDED members.
POSITIONS = 1 << 18
#: Sorted positions whose new bucket identifiers are written together, before the next ones are sorted.
SLICE = 1 << 16
#: Keys are two longs, so more of them than of wide rows may be broadcast; beyond that the join shuffles.
BROADCAST_KEYS = 5 * BROADCAST_ROWS
_WORDS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POSITION_BITS = 20
_CHUNK = 1 << 19


def gram_hashes(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """A 64-bit hash of the size bytes (a power of two) at each position, by doubling."""
    h, n, power = _WORDS[data], 1, 0x9E3779B97F4A7C15
    while n < size:
        h = h[:-n] * np.uint64(power) + h[n:]
        n, power = 2 * n, power * power % 2**64
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def runs(text: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring starts with the same anchor: first start, starts, anchor less first start, anchor hash."""
    data = np.frombuffer(text, np.uint8)
    out = []
    for low in range(0, max(0, len(data) - length + 1), _CHUNK):
        h = gram_hashes(data[low : low + _CHUNK + length - 1], anchor)
        mask = np.uint64((1 << _POSITION_BITS) - 1)
        least = sliding_min((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - anchor + 1)
        first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        at = (least[first] & mask).astype(np.int64)
        out.append((first + low, np.diff(np.concatenate([first, [len(least)]])), at - first, h[at].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("off", pa.int32()), ("h", pa.int64()), ("c", pa.int64())])


def _runs(length: int, anchor: int) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            held: list[tuple[np.ndarray, ...]] = []
            size = 0
            for k1, k2, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).cast(pa.binary()).to_pylist(), strict=True):
                if len(text) < length:
                    continue
                lo, n, off, h = runs(text, length, anchor)
                c = np.array([xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(lo.tolist(), (lo + n + length - 1).tolist())], np.uint64).view(np.int64)
                held.append((np.full(len(lo), k1), np.full(len(lo), k2), lo, n, off, h, c))
                size += len(lo)
                if size > 50_000:
                    yield _stacked(held)
                    held, size = [], 0
            if held:
                yield _stacked(held)

    def _stacked(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(f.type.to_pandas_dtype())) for x, f in zip(zip(*held, strict=True), RUNS, strict=True)], schema=RUNS)

    return run


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for got in source:
        packed = [pack.compress(t) for t in got.column(3).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(got.column(i) for i in range(3)), pa.array(packed, pa.binary())], ["k1", "k2", "id", "packed"])


PIECES = pa.schema([("g", pa.int64()), ("x", pa.int64()), ("k", pa.int64()), ("j0", pa.int32()), ("n", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("bytes", pa.binary())])
PIECE_ROW = "g long, x long, k long, j0 int, n int, k1 long, k2 long, start int, bytes binary"


def dealt(g: int, k: int, j0: int, n: int, k1: int, k2: int, start: int, around: bytes, length: int, piece: int) -> Iterator[tuple]:
    """A member (j0: the anchor less the first start) in pieces of at most `piece` starts, each in the group of the bytes that all strings of its cell share."""
    s = 0
    while s < n:
        j = j0 - s  # from this start to the anchor
        cell = j // piece
        e = min(n, j0 - cell * piece + 1)
        shared = around[j0 - cell * piece : j0 - cell * piece - (piece - 1) + length]
        own = around[s : e + length - 1]
        yield xxhash.xxh3_64_intdigest(shared, (g ^ cell) % (1 << 64)) - (1 << 63), xxhash.xxh3_64_intdigest(own) - (1 << 63), k, j, e - s, k1, k2, start + s, own
        s = e


def _pieces(length: int, piece: int) -> Callable:
    """Documents with their wanted runs to the bytes around them; runs of crowded anchors in pieces."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def rows() -> Iterator[tuple]:
            for got in source:
                for k1, k2, packed, wanted in zip(*(got.column(i).to_pylist() for i in range(4)), strict=True):
                    text = unpack.decompress(packed)
                    for w in wanted:
                        lo, n, off, h, c, k = (w[f] for f in ("lo", "n", "off", "h", "c", "k"))
                        around = text[lo : lo + n + length - 1]
                        if w["crowded"]:
                            yield from dealt(h, k, off, n, k1, k2, lo, around, length, piece)
                        else:
                            yield h, c, k, off, n, k1, k2, lo, around

        yield from batches(rows(), PIECES)

    return run


def _dealt(length: int, piece: int) -> Callable:
    """Rows (g, k, j0, n, k1, k2, start, bytes) of crowded groups in smaller pieces."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((out for got in source for row in zip(*(got.column(i).to_pylist() for i in range(8)), strict=True) for out in dealt(*row, length, piece)), PIECES)

    return run


def refine(groups: list[list[tuple[int, int, bytes]]], length: int = LENGTH, slice_: int = SLICE) -> list[list[np.ndarray]]:
    """groups of (offset of the anchor from the first start, starts, bytes) to, for each, which starts have an equal string in another member."""
    flat = [(g, j0, n, raw) for g, members in enumerate(groups) for j0, n, raw in members]
    sizes = np.array([len(f[3]) for f in flat])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    total = int(begin[-1])
    data = b"".join(f[3] for f in flat) + bytes(GRAM)
    where = np.arange(total, dtype=np.int32)
    member = np.repeat(np.arange(len(flat), dtype=np.int32), sizes)
    room = begin[1:].astype(np.int32)[member] - where  # bytes to the end of the member
    # Strings can be equal only at the same distance from the anchor of the same group: a lane.
    inside = where - begin[:-1].astype(np.int32)[member]
    j0 = np.array([f[1] for f in flat], np.int32)
    far = int(j0.max())
    lane = np.array([f[0] for f in flat], np.int64)[member] * (int(sizes.max()) + far + 1) + (inside - j0[member] + far)
    is_start = inside < np.array([f[2] for f in flat], np.int32)[member]
    # Initial buckets by q-gram and lane; at a member's end the gram is short, and shorter ones come first.
    words = np.ndarray(total, ">u8", data, 0, (1,))
    gram = words.astype(np.uint64)
    short = np.flatnonzero(room < GRAM)
    cut = (8 * (GRAM - room[short])).astype(np.uint64)
    gram[short] = gram[short] >> cut << cut
    sa = np.argsort(gram).astype(np.int32)
    ranked = gram[sa]
    number = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
    several = np.flatnonzero(np.bincount(number)[number] > 1)
    key = lane * (GRAM + 1) + np.minimum(room, GRAM)
    own = sa[several]
    sa[several] = own[np.lexsort((key[own], number[several]))]
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (np.diff(key[sa]) != 0)])
    first = np.flatnonzero(new)
    bucket = np.repeat(first, np.diff(np.concatenate([first, [total]])))
    ids = np.empty(total, np.int64)  # bucket identifiers: the first place of the bucket in the order
    ids[sa] = bucket
    depth = np.full(total, GRAM, np.int32)
    shared = np.flatnonzero(np.bincount(bucket, minlength=total)[bucket] > 1)
    active = shared
    while len(active):
        later = []
        low = 0
        while low < len(active):
            high = min(len(active), low + slice_)
            while high < len(active) and ids[sa[active[high]]] == ids[sa[active[high - 1]]]:
                high = min(len(active), int(low + slice_ + np.searchsorted(ids[sa[active[low + slice_ :]]], ids[sa[active[high - 1]]], "right")))
            slot = active[low:high]
            low = high
            at = sa[slot]
            offset = np.minimum(depth[at], length - GRAM)
            inside_it = room[at] > offset
            target = np.where(inside_it, at + offset, at)
            pointer = np.where(inside_it, ids[target], -1)
            keys = ids[at] * (total + 1) + pointer + 1
            order = np.argsort(keys)
            at, keys, inside_it = at[order], keys[order], inside_it[order]
            reached = np.where(inside_it, offset[order] + depth[target[order]], length)
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            first = np.flatnonzero(new)
            count = np.diff(np.concatenate([first, [len(at)]]))
            sa[slot] = at
            ids[at] = np.repeat(slot[first], count)
            depth[at] = reached
            later.append(slot[(np.repeat(count, count) > 1) & (reached < length)])
        active = np.concatenate(later)
    # Neighbours in the order, compared in full.
    ends = sa[shared]
    ends = ends[is_start[ends]]
    a, b = ends[:-1], ends[1:]
    for offset in (*range(0, length - GRAM, GRAM), length - GRAM):
        same = words[a + offset] == words[b + offset]
        if not offset:
            same &= lane[a] == lane[b]
        a, b = a[same], b[same]
    equal = np.zeros(total, bool)
    equal[a] = equal[b] = True
    out, k = [], 0
    for members in groups:
        out.append([equal[begin[k + i] : begin[k + i] + n] for i, (_, n, _) in enumerate(members)])
        k += len(members)
    return out


def _sorted_groups(length: int, positions: int) -> Callable:
    """Rows (g, k, j0, n, k1, k2, start, bytes) sorted by g to ranges of repeated starts of the members that stand for one run."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(groups: list[list[tuple]]) -> Iterator[tuple]:
            for members, flags in zip(groups, refine([[(m[2], m[3], m[7]) for m in g] for g in groups], length), strict=True):
                for (_, k, _, _, k1, k2, start, _), flag in zip(members, flags, strict=True):
                    if k == 1 and flag.any():
                        edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                            yield k1, k2, start + a, start + b

        def rows() -> Iterator[tuple]:
            groups: list[list[tuple]] = []
            size = 0
            for got in source:
                for row in zip(*(got.column(i).to_pylist() for i in range(8)), strict=True):
                    if not groups or groups[-1][0][0] != row[0]:
                        if size > positions:
                            yield from done([g for g in groups if len(g) > 1])
                            groups, size = [], 0
                        groups.append([])
                    groups[-1].append(row)
                    size += len(row[7])
            if groups := [g for g in groups if len(g) > 1]:
                yield from done(groups)

        yield from batches(rows(), pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))

    return run


def _cut(length: int) -> Callable:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for got in source:
            sizes, spans, kept = [], [], []
            for packed, ranges in zip(got.column(1).to_pylist(), got.column(2).to_pylist(), strict=True):
                text = unpack.decompress(packed)
                own: list[list[int]] = []
                for a, b in sorted((r["a"], r["b"] + length - 1) for r in ranges or ()):
                    if own and a <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], b)
                    else:
                        own.append([a, b])
                edges = [0, *(x for s in own for x in s), len(text)]
                sizes.append(len(text))
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, crowded: int = CROWDED, pieces_of: tuple[int, ...] = PIECES_OF) -> DataFrame:
    """One row for each row of docs: id, n_bytes, spans array<struct<start, end>> (maximal removed runs), kept binary.

    A byte is removed if a string of `length` bytes that starts anywhere else too, in any row, covers it. Texts are
    UTF-8; a null text is empty; ids may be null or repeat; repeated rows are copies of each other. anchor is a power of
    two below length, length at least 8. An empty table gives an empty result. Runs whose surroundings agree in the
    64-bit hash of their anchor and another 64-bit hash of all their bytes count as equal before the sort; pieces of
    crowded groups are grouped by their bytes.
    """
    text = text_of(column(docs, text_col))
    name = column(docs, id_col).cast("string")
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.xxhash64(F.lit(1), name, text).alias("k1"), F.xxhash64(text, name, F.lit(2)).alias("k2"), column(docs, id_col).alias("id"), text.alias("text"))
    table = written(base.select("k1", "k2", "text").mapInArrow(_runs(length, anchor), "k1 long, k2 long, lo int, n int, off int, h long, c long"), "suffix-runs")
    anchors = written(table.groupBy("h").count().where("count > 1").select(F.col("h").alias("h1")), "suffix-anchors")
    shared = table.join(small_or_not(anchors, anchors.count(), BROADCAST_KEYS), F.col("h") == F.col("h1"), "left_semi")
    one = F.min(F.struct("k1", "k2", "lo", "n", "off")).alias("one")
    contexts = written(shared.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"), one), "suffix-contexts")
    # Equal surroundings in several places: all their starts repeat.
    whole = written(contexts.where("k > 1").select(F.col("h").alias("h2"), F.col("c").alias("c2")), "suffix-whole")
    whole = table.join(small_or_not(whole, whole.count(), BROADCAST_KEYS), (F.col("h") == F.col("h2")) & (F.col("c") == F.col("c2")), "left_semi")
    found = whole.select("k1", "k2", F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))
    # Different surroundings of one anchor: sort.
    many = contexts.groupBy(F.col("h").alias("h3")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    wanted = contexts.join(many, F.col("h") == F.col("h3")).select(F.struct("one.lo", "one.n", "one.off", "h", "c", "k", (F.col("m") > crowded).alias("crowded")).alias("w"), "one.k1", "one.k2")
    wanted = wanted.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_list("w").alias("wanted"))
    packed = base.mapInArrow(_packed, f"k1 long, k2 long, id {kind}, packed binary")
    pieces = packed.drop("id").join(wanted, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2"))).select("k1", "k2", "packed", "wanted")
    pieces = written(pieces.mapInArrow(_pieces(length, pieces_of[0]), PIECE_ROW), "suffix-pieces")
    columns = ("g", "k", "j0", "n", "k1", "k2", "start", "bytes")
    for smaller in (*pieces_of[1:], None):
        # Pieces that are equal in full count once; of those, each of several places repeats.
        equal = pieces.groupBy("g", "x", "j0", "n", "bytes").agg(F.sum("k").alias("k"), F.min(F.struct("k1", "k2", "start")).alias("one"), F.count(F.lit(1)).alias("rows"))
        equal = written(equal.select("g", "x", "k", "j0", "n", "one.k1", "one.k2", "one.start", "bytes", "rows"), "suffix-equal")
        several = equal.where("rows > 1").select(*(F.col(c).alias("_" + c) for c in ("g", "x", "j0", "n")))
        several = pieces.drop("bytes").where("k = 1").join(several, (F.col("g") == F.col("_g")) & (F.col("x") == F.col("_x")) & (F.col("j0") == F.col("_j0")) & (F.col("n") == F.col("_n")), "left_semi")
        found = found.unionByName(several.select("k1", "k2", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b")))
        groups = equal.groupBy(F.col("g").alias("g1")).agg(F.count(F.lit(1)).alias("m"))
        full = written(groups.where(F.col("m") > crowded).select("g1"), "suffix-crowded")
        number = full.count() if smaller else 0
        plain = equal.select(*columns)
        if number:
            plain = plain.join(small_or_not(full, number, BROADCAST_KEYS), F.col("g") == F.col("g1"), "left_anti")
        ranges = plain.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_sorted_groups(length, POSITIONS), "k1 long, k2 long, a int, b int")
        found = found.unionByName(ranges)
        if not number:
            break
        over = equal.select(*columns).join(small_or_not(full, number, BROADCAST_KEYS), F.col("g") == F.col("g1"), "left_semi")
        pieces = written(over.mapInArrow(_dealt(length, smaller), PIECE_ROW), "suffix-pieces")
    found = written(found.groupBy(F.col("k1").alias("w1"), F.col("k2").alias("w2")).agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "suffix-ranges")
    cut = packed.join(found, (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")), "left").select("id", "packed", "ranges")
    return cut.mapInArrow(_cut(length), f"id {kind}, n_bytes long, spans array<struct<start: long, end: long>>, kept binary").withColumnRenamed("id", id_col)
