"""Top-k, normalising, fusing and reranking of scored candidates.

Scores are compared after rounding to nine digits and ties go to the smaller id, so a ranking doesn't depend on the
order of a sum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakequill.operators.sizes import small_or_shuffled
from lakequill.operators.store import materialized

DIGITS = 9


def top_k(scored: DataFrame, limit: int, *ties: str, by: str = "query_id") -> DataFrame:
    """(query_id, rank, chunk_id, score) of the best `limit` of each query."""
    w = Window.partitionBy(by).orderBy(F.round("score", DIGITS).desc(), *ties, "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(by, "rank", "chunk_id", "score")


def best_cells(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k best finite scores of each row; of equal ones those of the first columns."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        more, same = scores > least[:, None], scores == least[:, None]
        keep = more | (same & (np.cumsum(same, axis=1) <= (k - more.sum(axis=1))[:, None]))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & np.isfinite(scores))


def min_max(score: Column, *by: str, flat: float = 1.0) -> Column:
    """Between 0 and 1 within the group; `flat` for all where they are equal."""
    w = Window.partitionBy(*by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.lit(flat)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def fuse(legs: Sequence[tuple[DataFrame, float]], limit: int, candidates: int = 30) -> DataFrame:
    """Weighted sum of min-max scores over each leg's best candidates; an absent leg adds 0, ties keep the first leg's order."""
    parts = None
    for i, (leg, weight) in enumerate(legs):
        best = leg.where(F.col("rank") <= candidates)
        part = best.select("query_id", "chunk_id", (weight * min_max(F.col("score"), "query_id")).alias("part"), F.lit(i).alias("leg"), "rank")
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"), F.min(F.struct("leg", "rank")).alias("seen"))
    return top_k(fused.withColumns({"leg": F.col("seen.leg"), "leg_rank": F.col("seen.rank")}), limit, "leg", "leg_rank")


def reciprocal_rank_fusion(legs: Sequence[DataFrame], limit: int, k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank): an extra to compare with, no part of the method catalog."""
    union = None
    for leg in legs:
        part = leg.select("query_id", "chunk_id", (1.0 / (k + F.col("rank"))).alias("part"))
        union = part if union is None else union.unionByName(part)
    return top_k(union.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score")), limit)


def overlap_score(query: Column, text: Column) -> Column:
    """The offline stand-in of a cross-encoder: the share of the query's distinct tokens that the text holds."""
    from lakequill.functions.text import tokens

    asked = F.array_distinct(tokens(query))
    return F.size(F.array_intersect(asked, tokens(text))) / F.greatest(F.size(asked), F.lit(1))


def rerank(ranking: DataFrame, queries: DataFrame, chunks: DataFrame, limit: int, scorer: Callable[[Column, Column], Column] | Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None, candidates: int = 30, batches: bool = False) -> DataFrame:
    """Score each query's best candidates anew and order by that; equal scores keep their order.

    scorer: a column function of (query, text), or with batches=True a mapInPandas function that adds `score` to
    (query_id, rank, chunk_id, query, text), which is where a model goes.
    """
    pairs = materialized(ranking.where(F.col("rank") <= candidates).select("query_id", "rank", "chunk_id"), "rerank-pairs")
    texts = chunks.select(F.col("id").alias("chunk_id"), "text")
    held = texts.join(small_or_shuffled(pairs.select("chunk_id").distinct()), "chunk_id", "left_semi")  # texts of no candidate stay where they are
    pairs = pairs.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(held, "chunk_id")
    pairs = pairs.select("query_id", "rank", "chunk_id", "query", "text")
    if batches:
        scored = pairs.mapInPandas(scorer, pairs.schema.simpleString()[7:-1].replace(":", " ") + ", score double")
    else:
        scored = pairs.withColumn("score", (scorer or overlap_score)(F.col("query"), F.col("text")).cast("double"))
    return top_k(scored.withColumnRenamed("rank", "before"), limit, "before")
