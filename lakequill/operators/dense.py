"""Exact vector search in blocks.

Rows of both sides are packed into blocks, matrices of bounded bytes, in the executors; no vector passes the driver. Each
block of the stated queries meets each block of chunks, is multiplied with it and leaves its best k, so a shuffle sees
k rows for each query and block, whatever the number of chunks. Blocks are dealt out between packing and meeting: a task
that packs and a task that multiplies run one Python worker each, and no task runs both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakequill.operators.ranking import DIGITS, best_cells, top_k
from lakequill.operators.sizes import BROADCAST_ROWS
from lakequill.operators.store import materialized

#: Of a block of chunks and of queries; Spark hands over 10,000 rows at once, which are one block then.
BLOCK_BYTES = 16 << 20
ROWS, QUERIES = 10_000, 10_000
#: Numbers of a product that are held at once, as float64 8 MB; a block of queries is taken in slices.
PRODUCT = 1 << 20
#: Queries times dimensions that may be broadcast, as float32 64 MB.
BROADCAST_NUMBERS = 16 << 20


def _pack(rows: int) -> Callable:
    """Rows (id, vec, more ...) to blocks (ids, data, more ... as lists), sorted by id within."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            if not got.num_rows:
                continue
            got = got.take(pc.sort_indices(got.column(0)))
            step = max(1, min(rows, BLOCK_BYTES // max(1, 4 * len(got.column(1)[0]))))
            for low in range(0, got.num_rows, step):
                part = got.slice(low, step)
                whole = lambda c: pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.concat_arrays([c]))
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).tobytes()
                yield pa.RecordBatch.from_arrays([whole(part.column(0)), pa.array([data], pa.binary()), *(whole(part.column(i)) for i in range(2, part.num_columns))], ["ids", "data", *got.schema.names[2:]])

    return run


def blocks(rows: DataFrame, id_col: str, most: int, more: dict[str, Column] | None = None, prefix: str = "") -> DataFrame:
    """rows (id, vec) with further columns as blocks (ids, data, ...), their names prefixed; rows without a vector are left out."""
    more = more or {}
    held = rows.where("vec is not null").select(F.col(id_col).alias("id"), F.col("vec").cast("array<float>").alias("vec"), *(c.alias(n) for n, c in more.items()))
    kinds = dict(held.dtypes)
    packed = held.mapInArrow(_pack(most), f"ids array<{kinds['id']}>, data binary" + "".join(f", {n} array<{kinds[n]}>" for n in more))
    return packed.select(*(F.col(c).alias(prefix + c) for c in packed.columns))


def _matrix(data: pa.Scalar, rows: int) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.float32).reshape(rows, -1)


def _slices(asked: int, held: int) -> Iterator[slice]:
    """The queries of a block in turn, as many as make at most PRODUCT numbers with the chunks of another."""
    step = max(1, PRODUCT // max(1, held))
    return (slice(low, min(asked, low + step)) for low in range(0, asked, step))


def _met(queries: DataFrame, n: int, dims: int, chunks: DataFrame, q_more: dict[str, Column], more: dict[str, Column]) -> DataFrame:
    """Each block of queries (query_id, vec) with each of chunks (chunk_id, vec); the queries are broadcast if they are few enough, else pairs of partitions meet."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    parts = 1 + n // (4 * QUERIES)
    held = blocks(chunks, "chunk_id", ROWS, more)
    if n <= BROADCAST_ROWS and n * dims <= BROADCAST_NUMBERS:
        # A pair of blocks repeats both: full blocks of queries and several tasks for a core keep what a worker is handed at once small.
        return held.repartition(4 * cores).crossJoin(F.broadcast(blocks(queries.repartition(parts), "query_id", QUERIES, q_more, "q_")))
    return held.repartition(cores).hint("shuffle_replicate_nl").crossJoin(blocks(queries, "query_id", QUERIES, q_more, "q_").repartition(parts))


def _size(queries: DataFrame) -> tuple[int, int]:
    """How many queries have a vector, and its dimensions."""
    found = queries.where("vec is not null").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    return found["n"], found["dims"] or 0


def _exact_cells(sims: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sims = np.round(sims, DIGITS)
    sims[other] = -np.inf
    q, c = best_cells(sims, k)
    return q, c, sims[q, c]


def _cells(asked: np.ndarray, held: np.ndarray, other: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, chunk and score of the k best of each query; other: pairs that don't count.

    Products in single precision leave what can't be among them out, by a bound on their error; the rest is computed in
    double precision, as is all where that is too much, or where the numbers have no single precision.
    """
    whole = lambda: asked.astype(np.float64) @ held.astype(np.float64).T
    with np.errstate(all="ignore"):
        rough = asked @ held.T
        margin = 4 * (asked.shape[1] + 4) * 2.0**-24 * np.linalg.norm(asked, axis=1) * np.linalg.norm(held, axis=1).max(initial=0) + 4 * 10.0**-DIGITS + 1e-37
    if not (np.isfinite(rough).all() and np.isfinite(margin).all()):
        return _exact_cells(whole(), other, k)
    rough[other] = -np.inf
    n = rough.shape[1]
    least = rough.max(axis=1) if k == 1 else np.partition(rough, n - k, axis=1)[:, n - k] if n > k else np.full(len(rough), -np.inf)
    near = rough >= (least - margin)[:, None].astype(np.float32)
    near &= np.isfinite(rough)
    if np.count_nonzero(near) > rough.size // asked.shape[1]:  # as many numbers as the matrix has
        return _exact_cells(whole(), other, k)
    q, c = np.nonzero(near)
    score = np.round(np.einsum("ij,ij->i", asked[q].astype(np.float64), held[c].astype(np.float64)), DIGITS)
    order = np.lexsort((c, -score, q))
    q, c, score = q[order], c[order], score[order]
    first = np.searchsorted(q, q)
    use = np.arange(len(q)) - first < k
    return q[use], c[use], score[use]


def _best(k: int, grouped: bool, schema: pa.Schema) -> Callable:
    """Pairs of blocks to the k best chunks of each query, by the score to nine digits, then by id."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in source:
            for i in range(got.num_rows):
                row = {name: got.column(name)[i] for name in got.schema.names}
                ids, asked = row["ids"].values, row["q_ids"].values
                vecs, held = _matrix(row["q_data"], len(asked)), _matrix(row["data"], len(ids))
                both = pa.concat_arrays([row["q_group"].values, row["group"].values]).dictionary_encode(null_encoding="encode").indices.to_numpy() if grouped else None
                for s in _slices(len(asked), len(ids)):
                    other = both[s, None] == both[None, len(asked) :] if grouped else np.zeros((s.stop - s.start, len(ids)), bool)  # groups as numbers
                    q, c, score = _cells(vecs[s], held, other, k)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(q + s.start)), ids.take(pa.array(c)), pa.array(score)], schema=schema)

    return run


def dense_top_k(queries: DataFrame, chunks: DataFrame, limit: int = 10, group_col: str | None = None) -> DataFrame:
    """queries (query_id, vec[, group]) against chunks (chunk_id, vec[, group]) by dot product; with group_col only chunks of other groups count.

    Rows without a vector are left out: check readiness first where that must not happen. Without queries or chunks the
    ranking is empty. Scores have nine digits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    q_type, c_type = (df.schema[c].dataType.simpleString() for df, c in ((queries, "query_id"), (chunks, "chunk_id")))
    result = f"query_id {q_type}, chunk_id {c_type}, score double"
    group = {"group": F.col(group_col).cast("string")} if group_col else {}
    met = _met(queries, *_size(queries), chunks, group, group)
    schema = to_arrow_schema(queries.sparkSession.createDataFrame([], result).schema)
    return top_k(met.mapInArrow(_best(limit, bool(group), schema), result), limit)


def _above(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks to, for each query, how many chunks are more similar than its own, and the best of the others."""
    for got in source:
        for i in range(got.num_rows):
            row = {name: got.column(name)[i] for name in got.schema.names}
            ids, asked = row["ids"].values, row["q_ids"].values
            base = row["q_own"].values.to_numpy(zero_copy_only=False)
            vecs, held = _matrix(row["q_data"], len(asked)), _matrix(row["data"], len(ids)).astype(np.float64).T
            own = pc.fill_null(pc.index_in(row["q_own_id"].values, ids), -1).to_numpy(zero_copy_only=False)  # -1: not in this block
            for s in _slices(len(asked), len(ids)):
                sims = vecs[s].astype(np.float64) @ held
                np.round(sims, DIGITS, out=sims)
                here = np.flatnonzero(own[s] >= 0)
                sims[here, own[s][here]] = -np.inf
                yield pa.RecordBatch.from_arrays([asked[s], pa.array((sims > base[s, None]).sum(axis=1)), pa.array(sims.max(axis=1)), pa.array(base[s])], ["query_id", "above", "best", "own"])


def own_rank_margin(queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, dense_rank, margin): 1 + chunks more similar than the query's own (own_id), and own less best other similarity, four digits."""
    vec = lambda c: F.col(c).cast("array<float>").cast("array<double>")
    own = queries.join(chunks.select(F.col("chunk_id").alias("own_id"), F.col("vec").alias("own_vec")), "own_id").where("vec is not null and own_vec is not null")
    base = F.round(F.aggregate(F.zip_with(vec("vec"), vec("own_vec"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x), 9)
    met = _met(own.withColumn("own", base), *_size(queries), chunks, {"own_id": F.col("own_id"), "own": F.col("own")}, {})
    found = met.mapInArrow(_above, f"query_id {queries.schema['query_id'].dataType.simpleString()}, above long, best double, own double")
    found = found.groupBy("query_id").agg((1 + F.sum("above")).alias("dense_rank"), F.round(F.max("own") - F.max("best"), 4).alias("margin"))
    return found.select("query_id", "dense_rank", F.when(F.abs("margin") != float("inf"), F.col("margin")).alias("margin"))


def centred(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(chunk_id, ..., vec), written: cut to dims, unit length, less the mean of all, unit length again."""
    from lakequill.functions.vectors import shortened, unit

    first = materialized(vectors.withColumn("vec", shortened(F.col("vec"), dims) if dims else unit(F.col("vec"))), "unit-vectors")
    means = first.select(F.posexplode("vec").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("x"))
    mean = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))  # one row of one vector
    moved = first.crossJoin(F.broadcast(mean)).withColumn("vec", F.zip_with("vec", "mean", lambda a, b: a - b)).drop("mean")
    return materialized(moved.withColumn("vec", unit(F.col("vec"))), "centred-vectors")


def nearest_other(vectors: DataFrame, group_col: str) -> DataFrame:
    """(chunk_id, other_id, similarity): each vector's most similar one of another group; ties go to the smaller id."""
    found = dense_top_k(vectors.withColumnRenamed("chunk_id", "query_id"), vectors, 1, group_col)
    return found.select(F.col("query_id").alias("chunk_id"), F.col("chunk_id").alias("other_id"), F.col("score").alias("similarity"))


def similarity_bands(nearest: DataFrame, bands: tuple[float, ...] = (0.8, 0.85, 0.9, 0.95, 0.98)) -> DataFrame:
    """(band, share): the share of rows whose similarity reaches each band."""
    shares = nearest.agg(*(F.avg((F.col("similarity") >= b).cast("int")).alias(str(i)) for i, b in enumerate(bands)))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(str(i)).alias("share")) for i, b in enumerate(bands)))).alias("x")).select("x.*")


def not_ready(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunk ids without a usable vector; a method is ready if there are none."""
    from lakequill.functions.vectors import missing

    return chunks.select("chunk_id").join(vectors.where(~missing(F.col("vec"))).select("chunk_id"), "chunk_id", "left_anti")


def hashing_embedder(dims: int = 64, seed: int = 0) -> Callable[[pd.Series], pd.Series]:
    """The offline stand-in of an embedding model: signed token hashing to a unit vector, the same on every machine."""
    import re
    import zlib

    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts.fillna(""):
            v = np.zeros(dims, np.float32)
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = zlib.crc32(w.encode(), seed)
                v[h % dims] += 1 if h >> 16 & 1 else -1
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return pd.Series(out)

    return embed
