"""Exact dedup by Grace hashing: spill files until a bucket fits an open-addressing table of whole contents.

Two rounds. Each input partition first combines its own equal contents in a bounded table and passes on one row for
each distinct content, so a content that a third of all rows share crosses the shuffle once for each partition and
never as a group. The second round deals those rows out by hash and partitions each share recursively to spill files.
Each input row then finds its class by (partition, class number), a key that no hot group can make large.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lakequill.llm.common import UPPER, batches, column, small_or_not, text_of, written

FANOUT_BITS = 4
DEEPEST = 64 // FANOUT_BITS


class OpenTable:
    """Open addressing with linear probing over 64-bit hashes; equality is decided on the complete content."""

    def __init__(self, slots: int = 1024):
        self.slot = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.values: list = []
        self.held = 0

    def find(self, h: int, content: bytes) -> tuple[int, int]:
        """(index of the content or -1, slot at which the search ended)."""
        mask = len(self.slot) - 1
        at = h & mask
        while (i := self.slot[at]) >= 0:
            if self.hashes[i] == h and self.contents[i] == content:
                return int(i), at
            at = (at + 1) & mask
        return -1, at

    def insert(self, h: int, content: bytes, value, at: int) -> int:
        self.slot[at] = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.values.append(value)
        self.held += len(content)
        if 2 * len(self.hashes) > len(self.slot):
            self._grow()
        return len(self.hashes) - 1

    def _grow(self) -> None:
        mask = 2 * len(self.slot) - 1
        self.slot = np.full(mask + 1, -1, np.int64)
        for i, h in enumerate(self.hashes):
            at = h & mask
            while self.slot[at] >= 0:
                at = (at + 1) & mask
            self.slot[at] = i

    def rows(self) -> Iterator[tuple]:
        yield from zip(self.hashes, self.contents, self.values, strict=True)


def grace(rows: Iterable[tuple], merge: Callable, budget: int, level: int = 0, folder: str | None = None) -> Iterator[tuple]:
    """(hash, content, value) rows to one row for each distinct content, its values merged.

    While the distinct contents fit the budget, one table holds them. When they don't, the table and the rest of the
    rows go to spill files by the next bits of the hash, and each file is done the same way.
    """
    table, rows = OpenTable(), iter(rows)
    for h, content, value in rows:
        i, at = table.find(h, content)
        if i >= 0:
            table.values[i] = merge(table.values[i], value)
        elif table.held + len(content) <= budget or not table.hashes or level >= DEEPEST:
            table.insert(h, content, value, at)
        else:
            own = tempfile.mkdtemp(prefix="grace-", dir=folder)
            try:
                paths = [os.path.join(own, str(k)) for k in range(1 << FANOUT_BITS)]
                files = [open(p, "wb") for p in paths]
                shift, last = 64 - FANOUT_BITS * (level + 1), (1 << FANOUT_BITS) - 1
                for group in (table.rows(), [(h, content, value)], rows):
                    for row in group:
                        pickle.dump(row, files[(row[0] >> shift) & last], protocol=5)
                del table
                for f in files:
                    f.close()
                for p in paths:
                    yield from grace(_spilled(p), merge, budget, level + 1, own)
                    os.unlink(p)
            finally:
                shutil.rmtree(own, ignore_errors=True)
            return
    yield from table.rows()


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _local(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("cls", pa.int64()), ("row", pa.int64()), ("id", kind), ("sha", pa.string()), ("n", pa.int64()), ("hash", pa.int64()), ("content", pa.binary())])


def _global(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("part", pa.int64()), ("cls", pa.int64()), ("keep_id", kind), ("group_size", pa.int64()), ("keep_part", pa.int64()), ("keep_row", pa.int64())])


def _better(a: tuple, b: tuple) -> tuple:
    """Of two (id, part, row) the one to keep: the largest id, nulls lowest, then the earliest row."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0], -x[1], -x[2]))


def _combine(budget: int, kind: pa.DataType) -> Callable:
    """Input rows to a row each without content, and a row with content for each class of the partition."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def classes_of(table: OpenTable, base: int) -> Iterator[tuple]:
            for k, (h, content, (n, best, _)) in enumerate(table.rows()):
                yield part, base + k, best[2], best[0], None, n, h - (1 << 63), content

        def rows() -> Iterator[tuple]:
            table, base, row = OpenTable(), 0, 0
            for got in source:
                ids, texts = got.column(0).to_pylist(), got.column(1).cast(pa.binary()).to_pylist()
                for doc_id, text in zip(ids, texts, strict=True):
                    content = (text or b"").lower()  # of bytes: A-Z only
                    h = xxhash.xxh3_64_intdigest(content)
                    i, at = table.find(h, content)
                    if i < 0 and table.hashes and table.held + len(content) > budget:
                        yield from classes_of(table, base)
                        base += len(table.hashes)
                        table = OpenTable()
                        i, at = table.find(h, content)
                    best = (doc_id, part, row)
                    if i < 0:
                        i = table.insert(h, content, [0, best, sha256(content).hexdigest()], at)
                    value = table.values[i]
                    value[0] += 1
                    value[1] = _better(value[1], best)
                    yield part, base + i, row, doc_id, value[2], None, None, None
                    row += 1
            yield from classes_of(table, base)

        yield from batches(rows(), _local(kind))

    return run


def _resolve(budget: int, kind: pa.DataType) -> Callable:
    """The classes of the partitions to classes of the whole table."""

    def merge(a: list, b: list) -> list:
        a[0] += b[0]
        a[1] = _better(a[1], b[1])
        a[2].extend(b[2])  # in place: a hot text has a member for each partition
        return a

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for got in source:
                for part, cls, row, doc_id, n, h, content in zip(*(got.column(i).to_pylist() for i in range(7)), strict=True):
                    yield h + (1 << 63), content, [n, (doc_id, part, row), [(part, cls)]]

        def out() -> Iterator[tuple]:
            for _, _, (n, best, members) in grace(rows(), merge, budget):
                for part, cls in members:
                    yield part, cls, best[0], n, best[1], best[2]

        yield from batches(out(), _global(kind))

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget_bytes: int = 48 << 20) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text is an empty one. Of equal texts the row with the
    largest id stays; null ids rank lowest; of repeated rows with the same id the earliest in its partition stays, so
    exactly one row of a group is kept. Ids may be numbers or text (ordered by code points). An empty table gives an empty result; columns besides the two are not read.
    budget_bytes bounds the contents that a task's table holds; more goes to spill files that the task removes.
    """
    id_type = docs.schema[id_col].dataType
    kind, arrow = id_type.simpleString(), to_arrow_type(id_type)
    narrow = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).cast("string").alias("text"))
    local = written(narrow.mapInArrow(_combine(budget_bytes, arrow), f"part long, cls long, row long, id {kind}, sha string, n long, hash long, content binary"), "exact-local")
    classes = (
        local.where("content is not null").select("part", "cls", "row", "id", "n", "hash", "content")
        .repartition(F.col("hash"))
        .mapInArrow(_resolve(budget_bytes, arrow), f"part long, cls long, keep_id {kind}, group_size long, keep_part long, keep_row long")
    )
    rows = local.where("content is null").select("part", "cls", "row", "id", "sha")
    return rows.join(classes, ["part", "cls"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        ((F.col("part") == F.col("keep_part")) & (F.col("row") == F.col("keep_row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    keys = exact_dedup(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    gone = keys.agg(F.count_if("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).where("__kept < __rows")
    gone = written(gone, "exact-gone")
    sha = F.sha2(F.translate(text_of(column(docs, text_col)), UPPER, UPPER.lower()), 256)
    same = lambda keys: column(docs, id_col).eqNullSafe(keys["__id"]) & (sha == keys["__sha"])
    found = docs.join(small_or_not(gone, gone.count()), same(gone), "left_anti")
    repeated = gone.where("__kept > 0")  # rows that repeat with their ids: one stays
    many = repeated.count()
    if many:
        held = docs.join(small_or_not(repeated, many), same(repeated), "left_semi").select(*(column(docs, c).alias(f"c{i}") for i, c in enumerate(docs.columns)), column(docs, id_col).alias("i"), sha.alias("s"))
        found = found.unionAll(held.dropDuplicates(["i", "s"]).drop("i", "s").toDF(*docs.columns))
    return found
