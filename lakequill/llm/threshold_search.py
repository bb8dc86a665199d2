"""The k best candidates of many queries by exact inner product, found in three phases with a uniform threshold.

Vectors are cut into parts; for a query, each part makes a list of local scores, and a candidate's score is the sum of
its local scores. Phase 1 gathers the heads of all lists and scores them exactly: the (k + 1)-th best is a safe cutoff.
Whoever reaches the cutoff reaches cutoff / parts in at least one list. Phase 2 broadcasts the cutoffs and collects all
such entries. Phase 3 puts the entries of a candidate together, drops those that cannot reach the cutoff and computes
what no list has told.

Equal vectors are one candidate with its smallest ids, and one query with all its ids, so a vector that many rows share
costs what one costs. Queries are handled QUERIES at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.llm.common import column, shared_dir, small_or_not, written
from lakequill.llm.integer_vectors import MOST, MOST_DIMS, matrix, scaled, usable

#: Queries of one pass at most: their vectors and cutoffs are broadcast. They come in blocks of BLOCK.
QUERIES, BLOCK = 16_384, 2_048
#: Entries that the first phase takes of each list.
HEADS = 32
#: Queries that a product takes at once: 8 * 256 * 10,000 bytes with a whole Arrow batch.
STEP = 256


def parts_of(dims: int, parts: int) -> list[tuple[int, int]]:
    """Bounds of about equal parts; none is empty."""
    cuts = np.linspace(0, dims, min(parts, max(1, dims)) + 1).astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


class Asked:
    """The queries of a pass on their way to the executors: vectors, bounds of the parts, cutoffs."""

    def __init__(self, ints: np.ndarray, bounds: list[tuple[int, int]], cutoffs: np.ndarray | None = None):
        self.ints, self.bounds, self.cutoffs = ints, bounds, cutoffs

    def scores(self, queries: slice, other: np.ndarray, part: int) -> np.ndarray:
        """Local scores of some queries and all rows of other; exact: floats only where every sum stays below 2**53."""
        low, high = self.bounds[part]
        own = self.ints[queries, low:high]
        largest = int(np.abs(own).max(initial=0)) * int(np.abs(other).max(initial=0)) * max(1, high - low)
        if largest < 1 << 53:
            return (own.astype(np.float64) @ other.astype(np.float64).T).astype(np.int64)
        return own @ other.T


def _lists(got: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, candidates, vectors) of a batch of lists."""
    part = got.column("part").to_numpy()
    for p in np.unique(part):
        own = got.filter(pa.array(part == p))
        yield int(p), own.column("cid").to_numpy(), matrix(own.column("ints"))


def _heads(asked: Broadcast, heads: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 1: of each query and list the best entries of this task, (q, part, cid, score)."""
    queries = asked.value
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for got in source:
        for part, cids, vectors in _lists(got):
            scores, ids = best.get(part, (np.empty((len(queries.ints), 0), np.int64), np.empty((len(queries.ints), 0), np.int64)))
            width = min(heads, scores.shape[1] + len(cids))
            new_scores, new_ids = np.empty((len(queries.ints), width), np.int64), np.empty((len(queries.ints), width), np.int64)
            for low in range(0, len(queries.ints), STEP):
                at = slice(low, low + STEP)
                local = queries.scores(at, vectors, part)
                both = np.concatenate([scores[at], local], axis=1)
                names = np.concatenate([ids[at], np.broadcast_to(cids, local.shape)], axis=1)
                top = np.argpartition(-both, width - 1, axis=1)[:, :width]
                new_scores[at], new_ids[at] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
            best[part] = new_scores, new_ids
    for part, (scores, ids) in best.items():
        q = np.repeat(np.arange(len(scores), dtype=np.int32), scores.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), part, np.int32)), pa.array(ids.ravel()), pa.array(scores.ravel())], ["q", "part", "cid", "score"])


def _scored(asked: Broadcast, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q, cid, ints) to (q, cid, score), exact."""
    queries = asked.value
    for got in source:
        if got.num_rows:
            score = np.einsum("ij,ij->i", queries.ints[got.column("q").to_numpy()], matrix(got.column("ints")))
            yield pa.RecordBatch.from_arrays([got.column("q"), got.column("cid"), pa.array(score)], ["q", "cid", "score"])


def _entries(asked: Broadcast, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 2: of each candidate of a list the queries whose local score reaches cutoff / parts: (cid, qs, scores)."""
    queries = asked.value
    parts = len(queries.bounds)
    least = -(-queries.cutoffs // parts)  # of integers: local >= cutoff / parts
    for got in source:
        for part, cids, vectors in _lists(got):
            found = []
            for low in range(0, len(queries.ints), STEP):
                at = slice(low, low + STEP)
                local = queries.scores(at, vectors, part)
                q, c = np.nonzero(local >= least[at, None])
                found.append((c, q + low, local[q, c]))
            c, q, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(c, kind="stable")
            c, q, score = c[order], q[order].astype(np.int32), score[order]
            present, starts = np.unique(c, return_index=True)
            offsets = pa.array(np.append(starts, len(c)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cids[present]), pa.ListArray.from_arrays(offsets, pa.array(q)), pa.ListArray.from_arrays(offsets, pa.array(score))], ["cid", "qs", "scores"])


def _resolved(asked: Broadcast, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 3: (cid, ints, members, qs, scores), the entries of all lists one after another, to exact (q, cid, members, score) of at least the cutoff."""
    queries = asked.value
    parts, n = len(queries.bounds), len(queries.ints)
    least = -(-queries.cutoffs // parts)
    for got in source:
        lengths = got.column("qs").value_lengths().to_numpy()
        row = np.repeat(np.arange(got.num_rows), lengths)
        key, at = np.unique(row * n + got.column("qs").flatten().to_numpy(), return_inverse=True)
        told, total = np.bincount(at, minlength=len(key)), np.zeros(len(key), np.int64)
        np.add.at(total, at, got.column("scores").flatten().to_numpy())
        row, q = key // n, key % n
        hopeful = total + (parts - told) * (least[q] - 1) >= queries.cutoffs[q]  # a list that is silent holds less than cutoff / parts
        row, q, told, total = row[hopeful], q[hopeful], told[hopeful], total[hopeful]
        open_ = np.flatnonzero(told < parts)
        vectors = matrix(got.column("ints"))
        for low in range(0, len(open_), 65_536):
            some = open_[low : low + 65_536]
            total[some] = np.einsum("ij,ij->i", queries.ints[q[some]], vectors[row[some]])
        good = total >= queries.cutoffs[q]
        rows = pa.array(row[good])
        yield pa.RecordBatch.from_arrays([pa.array(q[good].astype(np.int32)), got.column("cid").take(rows), got.column("members").take(rows), pa.array(total[good])], ["q", "cid", "members", "score"])


def _packed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, ints) to blocks of at most BLOCK queries: cids, ints one after another."""
    for got in source:
        for low in range(0, got.num_rows, BLOCK):
            part = got.slice(low, BLOCK)
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)
            yield pa.RecordBatch.from_arrays([one(part.column("cid")), one(part.column("ints").flatten())], ["cids", "ints"])


def _ranked(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; Spark cuts groups before the shuffle too."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def _pass(spark: SparkSession, ints: np.ndarray, bounds: list[tuple[int, int]], lists: DataFrame, classes: DataFrame, k: int, heads: int, members: str) -> DataFrame:
    """(q, best: array of (score, cid, members)) of the queries of one pass, best first."""
    asked = spark.sparkContext.broadcast(Asked(ints, bounds))
    local = lists.mapInArrow(partial(_heads, asked, max(heads, k + 1)), "q int, part int, cid bigint, score bigint")
    known = written(_ranked(local, ["q", "part"], [F.desc("score"), "cid"], max(heads, k + 1)).select("q", "cid").distinct(), "heads")
    exact = classes.select("cid", "ints").join(small_or_not(known, known.count()), "cid").select("q", "cid", "ints").mapInArrow(partial(_scored, asked), "q int, cid bigint, score bigint")
    cut = _ranked(exact, ["q"], [F.desc("score"), "cid"], k + 1).groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("cutoff"))
    cutoffs = np.full(len(ints), -(MOST * MOST * MOST_DIMS), np.int64)  # below every score: too few candidates for a cutoff
    for row in cut.where(F.col("n") > k).collect():  # a row for each query of the pass
        cutoffs[row["q"]] = row["cutoff"]
    asked.destroy()
    asked = spark.sparkContext.broadcast(Asked(ints, bounds, cutoffs))
    entries = lists.mapInArrow(partial(_entries, asked), "cid bigint, qs array<int>, scores array<bigint>")
    entries = entries.groupBy("cid").agg(F.collect_list(F.struct("qs", "scores")).alias("told"))  # a row of each list at most
    entries = entries.select("cid", F.flatten("told.qs").alias("qs"), F.flatten("told.scores").alias("scores"))
    found = classes.join(entries, "cid").select("cid", "ints", "members", "qs", "scores").mapInArrow(partial(_resolved, asked), f"q int, cid bigint, members {members}, score bigint")
    best = _ranked(found, ["q"], [F.desc("score"), F.col("members")[0], "cid"], k + 1)
    return best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "cid", "members"))).alias("best"))


def top_inner_products(
    vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 50, k: int = 5, factor: int = 256, parts: int = 2, heads: int = HEADS, most_queries: int = QUERIES
) -> DataFrame:
    """(query_id, rank, id, score): for each row whose id is divisible by `every` its k best other rows by integer inner product.

    Components become floor(factor * x), cut to +-2**24; a shorter vector counts as filled up with zeros. Vectors that are
    null or hold a null or non-finite component take no part. Ties go to the smaller id, null ids last. A row is never its
    own candidate, but another row with the same id is; a query that stands twice is answered twice. Rows with a null id
    ask nothing. With fewer candidates than k all are returned. An empty table gives an empty result. Columns other than
    these two are not read.

    Work grows with queries times rows, as the question does; shuffled are the entries at or above a cutoff.
    """
    spark, vec, own_id = vectors.sparkSession, column(vectors, vec_col), column(vectors, id_col)
    good = vectors.where(usable(vec)).select(own_id.alias("id"), scaled(vec, factor).alias("ints"))
    kind = good.schema["id"].dataType.simpleString()
    members = f"array<struct<none:boolean,id:{kind}>>"
    dims = good.agg(F.max(F.size("ints"))).first()[0]
    result = f"query_id {kind}, rank int, id {kind}, score bigint"
    if dims is None:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)
    if dims > MOST_DIMS:
        raise ValueError(f"vectors have more than {MOST_DIMS} components")
    good = good.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0), F.lit(dims) - F.size("ints"))))
    bounds = parts_of(dims, parts)

    smallest = _ranked(good, ["ints"], [F.col("id").asc_nulls_last()], k + 1)
    classes = smallest.groupBy("ints").agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).cast(members).alias("members"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "ints", "members"), "classes")
    asked = written(good.where(F.col("id") % every == 0).join(classes.select("cid", "ints"), "ints").select(F.col("id").alias("query_id"), "cid"), "asked")
    blocks = classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "ints").mapInArrow(_packed, "cids array<bigint>, ints array<int>")
    blocks = written(blocks.select(F.monotonically_increasing_id().alias("block"), "cids", "ints"), "query-blocks")
    path = f"{shared_dir(spark)}/lakequill/lists-{uuid.uuid4().hex}"
    lists = F.explode(F.array(*(F.struct(F.lit(i).alias("part"), F.slice("ints", low + 1, high - low).alias("ints")) for i, (low, high) in enumerate(bounds))))
    classes.select("cid", lists.alias("list")).select("cid", "list.part", "list.ints").write.partitionBy("part").parquet(path)
    lists = spark.read.schema("cid bigint, ints array<int>, part int").parquet(path)

    each, answers = max(1, most_queries // BLOCK), []
    names = sorted(r["block"] for r in blocks.select("block").collect())  # a number for each BLOCK queries
    for at in range(0, len(names), each):
        held = blocks.where(F.col("block").isin(names[at : at + each])).collect()  # most_queries vectors at most
        cids = np.array([c for r in held for c in r["cids"]], np.int64)
        ints = np.array([x for r in held for x in r["ints"]], np.int64).reshape(len(cids), dims)
        found = _pass(spark, ints, bounds, lists, classes, k, heads, members)
        numbers = spark.createDataFrame(list(enumerate(cids.tolist())), "q int, asked_cid bigint")
        answers.append(written(found.join(F.broadcast(numbers), "q").select("asked_cid", "best"), "answers"))
    if not answers:
        return spark.createDataFrame([], result).withColumnRenamed("id", id_col)

    answers = reduce(DataFrame.unionByName, answers)
    row = lambda c: F.transform(c["members"], lambda m: F.struct(c["less"].alias("less"), m["none"].alias("none"), m["id"].alias("id"), c["cid"].alias("cid")))
    answers = answers.select("asked_cid", F.array_sort(F.flatten(F.transform("best", row))).alias("best"))
    joined = asked.join(small_or_not(answers, answers.count()), F.col("cid") == F.col("asked_cid"))
    own = F.array_position(F.transform("best", lambda c: (c["cid"] == F.col("cid")) & c["id"].eqNullSafe(F.col("query_id"))), True)  # 0: not among the first
    others = F.filter("best", lambda c, i: i + 1 != own)
    top = joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("n", "hit"))
    return top.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), F.col("hit.id").alias(id_col), (-F.col("hit.less")).alias("score"))
