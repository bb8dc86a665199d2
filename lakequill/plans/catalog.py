"""Retrieval methods by name. A method is a plan builder: (queries, corpus, limit) to a ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.operators import geo, ranking, segments
from lakequill.operators.dense import dense_top_k, not_ready
from lakequill.operators.sparse import bm25
from lakequill.schemas import PROVIDERS

CANDIDATES = 30
VECTOR_WEIGHT, SPARSE_WEIGHT = 0.7, 0.3


@dataclass
class Corpus:
    """chunks (id, text). vectors and query_vectors: provider to (chunk_id, vec) and (query_id, vec). rerankers: '' and '_4b' to a scorer. places, points: for geography. index: a stored BM25 index of the chunks, which all sparse legs share; without one they read the chunks."""

    chunks: DataFrame
    vectors: dict[str, DataFrame] = field(default_factory=dict)
    query_vectors: dict[str, DataFrame] = field(default_factory=dict)
    rerankers: dict[str, Callable] = field(default_factory=dict)
    places: DataFrame | None = None
    points: DataFrame | None = None
    index: segments.Index | None = None


Method = Callable[[DataFrame, Corpus, int], DataFrame]


def sparse(queries: DataFrame, corpus: Corpus, limit: int) -> DataFrame:
    return segments.search(queries, corpus.index, limit) if corpus.index else bm25(queries, corpus.chunks, limit)


def dense(provider: str) -> Method:
    return lambda queries, corpus, limit: dense_top_k(corpus.query_vectors[provider].join(queries.select("query_id"), "query_id", "left_semi"), corpus.vectors[provider], limit)


def hybrid(provider: str) -> Method:
    """Fused from the best 30 of both legs, so no more than 60 can be asked for."""
    return lambda queries, corpus, limit: ranking.fuse([(dense(provider)(queries, corpus, CANDIDATES), VECTOR_WEIGHT), (sparse(queries, corpus, CANDIDATES), SPARSE_WEIGHT)], limit, CANDIDATES)


def reranked(base: Method, model: str) -> Method:
    return lambda queries, corpus, limit: ranking.rerank(base(queries, corpus, CANDIDATES), queries, corpus.chunks, limit, corpus.rerankers.get(model), CANDIDATES)


def located(base: Method) -> Method:
    """The stage below gives its 30 at most, however many are asked of it."""
    return lambda queries, corpus, limit: geo.geo_rerank(base(queries, corpus, max(limit * 4, limit)), corpus.places, corpus.points, limit)


def catalog() -> dict[str, Method]:
    """All methods: sparse with two rerankers; for each provider dense and hybrid, each with two, and the hybrid reranked one with geography."""
    out: dict[str, Method] = {"sparse": sparse, "sparse_rerank": reranked(sparse, ""), "sparse_rerank_4b": reranked(sparse, "_4b")}
    for p in PROVIDERS:
        for name, base in ((p, dense(p)), (f"{p}_hybrid", hybrid(p))):
            out |= {name: base, f"{name}_rerank": reranked(base, ""), f"{name}_rerank_4b": reranked(base, "_4b")}
        out[f"{p}_hybrid_rerank_geo"] = located(out[f"{p}_hybrid_rerank"])
    return out


DEFAULTS = ("sparse", "qwen", "qwen_hybrid_rerank")


def resolve(names: list[str] | None) -> list[str]:
    """None or [] is the defaults, ['all'] everything; unknown names are an error that lists them."""
    known = catalog()
    if not names:
        return list(DEFAULTS)
    if names == ["all"]:
        return list(known)
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown methods: {', '.join(unknown)}; known: {', '.join(known)}")
    return names


def provider_of(name: str) -> str | None:
    found = name.split("_")[0]
    return found if found in PROVIDERS else None


def ensure_ready(names: list[str], corpus: Corpus) -> None:
    """Fails with the providers of which a chunk has no vector."""
    lacking = []
    for p in dict.fromkeys(filter(None, map(provider_of, resolve(names)))):
        have = corpus.vectors.get(p)
        if have is None or not not_ready(corpus.chunks.select(F.col("id").alias("chunk_id")), have).isEmpty():
            lacking.append(p)
    if lacking:
        raise RuntimeError("vectors are missing; build them with: " + "; ".join(f"python -m lakequill index --method {p}" for p in lacking))


def retrieve(name: str, queries: DataFrame, corpus: Corpus, limit: int = 10) -> DataFrame:
    """queries (query_id, text) to (method, query_id, rank, chunk_id, score); one query is a table of one row."""
    return catalog()[resolve([name])[0]](queries, corpus, limit).select(F.lit(name).alias("method"), "query_id", "rank", "chunk_id", "score")
