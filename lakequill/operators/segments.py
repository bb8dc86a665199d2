"""A stored BM25 index of document segments with block maxima.

A segment is a run of documents that one task reads, laid out so that documents with the same frequent words lie side by
side. It is cut into windows of WINDOW documents, and a block is one term's postings in one window: gaps between
document places, frequencies, and the pairs of frequency and length that no other pair of the block beats. Weights
are not stored: they follow from the counts of all segments, so segments are added without touching older ones, and a
block's maximum is exact under any mean length. A row of each window without a term holds its documents.

A search reads the blocks of its terms. Where the sum of a window's maxima stays below what a query's limit-th best
document already has, the query leaves the window's blocks undecoded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions.text import tokens
from lakequill.operators.ranking import DIGITS, top_k
from lakequill.operators.sparse import K1, B, idf, query_terms
from lakequill.operators.store import materialized

#: Documents of a window, of a segment, and tokens of a segment: a task holds one segment, at about 100 bytes a token while it is laid out.
WINDOW, SEGMENT_DOCS, SEGMENT_TOKENS = 128, 16_384, 1 << 20
#: Pairs of query and term of one pass of a search: their weights travel to the tasks.
PAIRS = 1 << 18


def _segment(number: int, ids: pa.Array, lists: pa.Array, schema: pa.Schema, width: int = WINDOW) -> pa.RecordBatch:
    """The rows of one segment: its documents laid out, a row of each window and of each block."""
    held = lists.fill_null([]) if lists.null_count else lists
    sizes = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    words = held.flatten().dictionary_encode()
    terms, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
    docs, n_docs, n_terms = np.repeat(np.arange(len(ids)), sizes), len(ids), max(1, len(terms))

    pairs, tf = np.unique(docs * n_terms + codes, return_counts=True)
    doc, term = pairs // n_terms, pairs % n_terms
    order = np.lexsort((-np.bincount(codes, minlength=n_terms)[term], -tf, doc))  # each document's most frequent word, then the next
    at = np.searchsorted(doc, np.arange(n_docs))
    top = [np.where(at + k < np.searchsorted(doc, np.arange(n_docs), side="right"), term[order][np.minimum(at + k, max(0, len(order) - 1))] if len(order) else 0, -1) for k in range(2)]
    place = np.empty(n_docs, np.int64)
    place[np.lexsort((sizes, top[1], top[0]))] = np.arange(n_docs)

    lengths = np.maximum(sizes, 1)
    by_place = np.argsort(place)
    cuts = np.arange(0, n_docs, width)
    ends = np.minimum(cuts + width, n_docs)
    window_lists = lambda values: pa.ListArray.from_arrays(pa.array(np.append(cuts, n_docs).astype(np.int32)), values)
    none = lambda kind, n: pa.nulls(n, kind)
    total = np.add.reduceat(lengths[by_place], cuts)
    heads = {"window": pa.array((cuts // width).astype(np.int32)), "n": pa.array((ends - cuts).astype(np.int32)), "total": pa.array(total), "ids": window_lists(ids.take(pa.array(by_place))), "lengths": window_lists(pa.array(lengths[by_place].astype(np.int32)))}

    spot = place[doc]
    order = np.lexsort((spot, term))
    spot, term, tf, length = spot[order], term[order], tf[order], lengths[doc][order]
    window = spot // width
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (window[1:] != window[:-1])]) if len(term) else np.empty(0, np.int64)
    block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(term))))
    gaps = np.diff(spot, prepend=0)
    gaps[starts] = spot[starts] % width
    best = np.lexsort((length, -tf, block))  # a pair stays if no pair of the same frequency or more is as short
    lowered = length[best] + (len(starts) - block[best]) * (1 << 40)  # later blocks are lower: the running minimum starts anew
    kept = best[lowered < np.minimum.accumulate(np.r_[1 << 62, lowered[:-1]])] if len(best) else best
    offsets = lambda counts: pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    own = offsets(np.diff(np.append(starts, len(term))))
    front = offsets(np.bincount(block[kept], minlength=len(starts)))
    ints = lambda x: pa.array(x.astype(np.int32))
    blocks = {
        "window": ints(window[starts]), "term": terms.take(pa.array(term[starts])), "n": ints(np.diff(np.append(starts, len(term)))), "gaps": pa.ListArray.from_arrays(own, ints(gaps)), "tfs": pa.ListArray.from_arrays(own, ints(tf)),
        "best_tfs": pa.ListArray.from_arrays(front, ints(tf[kept])), "best_lengths": pa.ListArray.from_arrays(front, ints(length[kept])),
    }
    rows = len(cuts) + len(starts)
    columns = []
    for f in schema:
        if f.name == "segment":
            columns.append(pa.array(np.full(rows, number)))
        else:
            columns.append(pa.concat_arrays([(part.get(f.name) if f.name in part else none(f.type, n)).cast(f.type) for part, n in ((heads, len(cuts)), (blocks, len(starts)))]))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _segments(schema: pa.Schema, most_docs: int, most_tokens: int, width: int, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) to the rows of segments; one is closed when it has enough documents or tokens."""
    first, held, docs, size = TaskContext.get().partitionId() << 32, [], 0, 0

    def closed() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks()
        return _segment(first, whole.column("id").combine_chunks(), whole.column("tokens").combine_chunks(), schema, width)

    for got in source:
        at = 0
        while at < got.num_rows:
            ends = got.column("tokens").offsets.to_numpy()[at + 1 :].astype(np.int64) - got.column("tokens").offsets[at].as_py()
            part = got.slice(at, min(most_docs - docs, int(np.searchsorted(ends, most_tokens - size)) + 1))  # up to the document that fills it
            held.append(part)
            at, docs, size = at + part.num_rows, docs + part.num_rows, size + len(part.column("tokens").flatten())
            if docs >= most_docs or size >= most_tokens:
                yield from _sliced(closed())
                first, held, docs, size = first + 1, [], 0, 0
    if docs:
        yield from _sliced(closed())


def _sliced(rows: pa.RecordBatch, most: int = 50_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, rows.num_rows, most):
        yield rows.slice(at, most)


def add_segments(docs: DataFrame, path: str, most_docs: int = SEGMENT_DOCS, most_tokens: int = SEGMENT_TOKENS, window: int = WINDOW) -> None:
    """Index docs (id, text) as new segments of the index at path, which need not exist; ids are new to it.

    A document without tokens, or with a null text, is held and never found. Files are as many as tasks read documents,
    so they follow the corpus. The segments count once their row in the manifest is written, which is last: a search
    meanwhile sees none of them, and what a lost job left is never read.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    kind = docs.schema["id"].dataType.simpleString()
    fields = f"segment bigint, window int, term string, n int, total bigint, gaps array<int>, tfs array<int>, best_tfs array<int>, best_lengths array<int>, ids array<{kind}>, lengths array<int>"
    schema = to_arrow_schema(spark.createDataFrame([], fields).schema)
    rows = docs.select("id", tokens(F.col("text")).alias("tokens")).mapInArrow(partial(_segments, schema, most_docs, most_tokens, window), fields)
    batch = uuid.uuid4().hex
    rows.sortWithinPartitions("term", "segment", "window").write.option("compression", "zstd").parquet(f"{path}/segments/{batch}")
    written = spark.read.schema(fields).parquet(f"{path}/segments/{batch}")
    counted = written.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), F.coalesce(F.sum("total"), F.lit(0)).cast("bigint").alias("total"))
    counted.select(F.lit(batch).alias("batch"), "n", "total", F.lit(fields).alias("fields")).coalesce(1).write.mode("append").parquet(f"{path}/manifest")


class Index:
    """An index as its manifest stands now."""

    def __init__(self, spark: SparkSession, path: str):
        batches = spark.read.parquet(f"{path}/manifest").collect()  # a row for each time that segments were added
        self.docs = sum(r["n"] for r in batches)
        self.mean_length = sum(r["total"] for r in batches) / self.docs if self.docs else 1.0
        one = lambda r: spark.read.schema(r["fields"]).parquet(f"{path}/segments/{r['batch']}").withColumn("batch", F.lit(r["batch"]))
        parts = [one(r) for r in batches]
        self.rows = parts[0]
        for p in parts[1:]:
            self.rows = self.rows.unionByName(p)


AT = ["batch", "segment", "window"]


def _saturation(mean_length: float, k1: float, b: float, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


class Asked:
    """The queries of a pass: for each term number its queries and their weights, one after another."""

    def __init__(self, pairs: list[tuple[int, int, float]], terms: int, queries: int):
        pairs = sorted(pairs)
        self.queries = queries
        self.q, self.w = np.array([p[1] for p in pairs], np.int64), np.array([p[2] for p in pairs], np.float64)
        self.starts = np.searchsorted(np.array([p[0] for p in pairs]), np.arange(terms + 1))

    def of(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, query, weight) of every query of every row's term."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(self.starts[terms] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.repeat(np.arange(len(terms)), sizes), self.q[at], self.w[at]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the spans, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _scored(asked: Asked, limit: int, mean_length: float, k1: float, b: float, blocks_of: Accumulator, scored: Accumulator, source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole windows, each window's together and its documents first, to (q, chunk_id, score) of the best documents of each query in each window.

    The windows of a batch come in the order of their bounds; a query skips a window whose bound is below what its
    limit-th best document of this task already has.
    """
    least = np.zeros((asked.queries, limit))  # the best scores of this task
    rest: list[pa.RecordBatch] = []
    for got in (*source, None):
        if got is not None:
            rest.append(got)
            heads = np.flatnonzero(got.column("t").to_numpy() < 0)
            if not len(heads):
                continue
            rest[-1], ahead = got.slice(0, heads[-1]), got.slice(heads[-1])  # the last window may go on in the next batch
        rows = pa.Table.from_batches(rest).combine_chunks() if rest else None
        rest = [ahead] if got is not None else []
        if rows is None or not rows.num_rows:
            continue
        rows = rows.to_batches(max_chunksize=rows.num_rows)[0]
        term = rows.column("t").to_numpy()
        heads = np.flatnonzero(term < 0)
        window = np.cumsum(term < 0) - 1
        lengths, ids = rows.column("lengths").flatten().to_numpy().astype(np.float64), rows.column("ids").flatten()
        sizes = rows.column("ids").take(pa.array(heads)).value_lengths().to_numpy().astype(np.int64)
        base = np.append(0, np.cumsum(sizes))
        blocks = np.flatnonzero(term >= 0)
        postings = rows.column("gaps").value_lengths().fill_null(0).to_numpy().astype(np.int64)[blocks]
        fronts = rows.column("best_tfs").value_lengths().fill_null(0).to_numpy().astype(np.int64)[blocks]
        if not len(blocks):
            continue
        maxima = np.maximum.reduceat(_saturation(mean_length, k1, b, rows.column("best_tfs").flatten().to_numpy().astype(np.float64), rows.column("best_lengths").flatten().to_numpy()), np.cumsum(fronts) - fronts)
        gaps, tf = rows.column("gaps").flatten().to_numpy().astype(np.int64), rows.column("tfs").flatten().to_numpy().astype(np.float64)
        first = np.cumsum(postings) - postings
        run = np.cumsum(gaps)
        doc = run - np.repeat(run[first] - gaps[first], postings) + np.repeat(base[window[blocks]], postings)
        weight = _saturation(mean_length, k1, b, tf, lengths[doc])
        pair, q, w = asked.of(term[blocks])
        of = window[blocks][pair]
        bounds = np.bincount(of * asked.queries + q, w * maxima[pair], minlength=len(heads) * asked.queries).reshape(len(heads), -1)
        cuts = np.searchsorted(of, np.arange(len(heads) + 1))
        blocks_of.add(len(pair))
        for v in np.argsort(-bounds.max(axis=1), kind="stable"):
            some = slice(cuts[v], cuts[v + 1])
            # Sums of floats: a bound must lie below by more than their rounding to be left out.
            open_ = (bounds[v] * (1 + 1e-9) + 1e-8 >= least.min(axis=1)) & (bounds[v] > 0)
            keep = some.start + np.flatnonzero(open_[q[some]])
            if not len(keep):
                continue
            scored.add(len(keep))
            names, local = np.unique(q[keep], return_inverse=True)
            spots = _spans(first[pair[keep]], postings[pair[keep]])
            per = postings[pair[keep]]
            cell = np.repeat(local, per) * sizes[v] + doc[spots] - base[v]
            score = np.bincount(cell, np.repeat(w[keep], per) * weight[spots], minlength=len(names) * sizes[v]).reshape(len(names), -1)
            rounded = np.round(score, DIGITS)
            both = np.concatenate([least[names], rounded], axis=1)
            least[names] = -np.partition(-both, limit - 1, axis=1)[:, :limit]
            at, d = np.nonzero((rounded >= least[names].min(axis=1)[:, None]) & (score > 0))  # ties included
            yield pa.RecordBatch.from_arrays([pa.array(names[at].astype(np.int32)), ids.take(pa.array(d + base[v])), pa.array(score[at, d])], ["q", "chunk_id", "score"])


def search(queries: DataFrame, index: Index, limit: int = 10, k1: float = K1, b: float = B, counts: dict | None = None, most_pairs: int = PAIRS) -> DataFrame:
    """BM25 of queries (query_id, text) over an index: the best `limit` of each query with positive scores, as sparse.bm25 over all its documents.

    Queries go in passes of about most_pairs pairs of query and term, whose weights travel to the tasks. A pass reads the
    blocks of its terms; they meet by window. counts, if given, gets how many pairs of query and block there were and how
    many were scored.
    """
    spark = queries.sparkSession
    kinds = [queries.schema["query_id"].dataType.simpleString(), index.rows.schema["ids"].dataType.elementType.simpleString()]
    asked = query_terms(queries.where("query_id is not null"))
    passes = -(-asked.count() // most_pairs) if index.docs else 0
    if passes > 1:
        asked = materialized(asked, "query-terms")
    out = spark.createDataFrame([], f"query_id {kinds[0]}, rank int, chunk_id {kinds[1]}, score double")
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else asked
        df = index.rows.where("term is not null").select("term", "n").join(own.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        pairs = own.join(df, "term").select("query_id", "term", (F.col("qtf") * idf(F.lit(index.docs), F.col("df"))).alias("w")).collect()  # about most_pairs
        names, terms = {}, {}
        for r in pairs:
            names.setdefault(r["query_id"], len(names)), terms.setdefault(r["term"], len(terms))
        weights = Asked([(terms[r["term"]], names[r["query_id"]], r["w"]) for r in pairs], len(terms), len(names))
        numbers = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, t int"))
        rows = index.rows.join(numbers, "term", "left").where("t is not null or term is null").withColumn("t", F.coalesce("t", F.lit(-1)))
        rows = rows.select(*AT, "t", "gaps", "tfs", "best_tfs", "best_lengths", "ids", "lengths").repartition(*AT).sortWithinPartitions(*AT, "t").drop(*AT)
        seen, scored = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
        found = rows.mapInArrow(partial(_scored, weights, limit, index.mean_length, k1, b, seen, scored), f"q int, chunk_id {kinds[1]}, score double")
        best = top_k(found, limit, by="q")
        if passes > 1 or counts is not None:
            best = materialized(best, "best")
        if counts is not None:
            counts |= {"pairs": counts.get("pairs", 0) + seen.value, "scored": counts.get("scored", 0) + scored.value}
        ids = F.broadcast(spark.createDataFrame([(n, q) for q, n in names.items()], f"q int, query_id {kinds[0]}"))
        best = best.join(ids, "q").select("query_id", "rank", "chunk_id", "score")
        out = best if i == 0 else out.unionByName(best)
    return out
