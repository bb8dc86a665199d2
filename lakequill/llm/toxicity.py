"""Toxicity by the nearest labelled examples.

A bounded, hashed sample of labelled texts is kept as TF-IDF vectors over all their words; document frequencies are those
of all documents, and words whose presence goes with the sample's labels beyond chance weigh more. A text's neighbours are found by exact cosine in an inverted index whose long lists are cut into
blocks of alike examples, each with its largest weight: the short lists are added up in full, the bound of a block is
the best such sum in it and what its maxima allow besides, and only blocks whose bound reaches the k-th best similarity
are opened. Distance-weighted votes are calibrated on the sample itself, each example left out of its own vote.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import column, small_or_not, text_of, written

#: Bound of the fitted model: labelled rows that are learnt from. All their words count.
MOST_EXAMPLES = 6_000
#: Voters: this share of the examples, and so many at least.
VOTERS_SHARE = 0.05
LEAST_VOTERS = 15
BLOCK = 64
#: A list is long, and so cut into blocks with maxima, if more than one in so many examples stands in it.
LONG_LIST = 16
#: Texts that are looked up together: their words' lists are held at once.
TOGETHER = 32
SHOWN = 5
#: A word counts beyond chance if its log-likelihood ratio exceeds this: chi-squared at 0.001, one degree of freedom.
CHANCE = 10.83
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(text: str) -> Counter:
    """Words of letters, lower-cased."""
    return Counter(_WORD.findall(text.lower()))


class Rows:
    """Sparse rows: terms and weights of row i are those from ends[i] to ends[i + 1]."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.ends, self.terms, self.weights = ends, terms, weights

    def __len__(self) -> int:
        return len(self.ends) - 1

    def part(self, low: int, high: int) -> Rows:
        a, b = self.ends[low], self.ends[high]
        return Rows(self.ends[low : high + 1] - a, self.terms[a:b], self.weights[a:b])

    def of(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.ends))


def unit_rows(ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> Rows:
    """TF-IDF vectors of length 1, the term frequency as 1 + ln(tf); a row without terms stays empty."""
    weights = (1 + np.log(tf)) * idf[terms]
    rows = Rows(ends, terms, weights)
    of = rows.of()
    norm = np.sqrt(np.bincount(of, weights * weights, minlength=len(rows)))
    rows.weights = weights / norm[of]
    return rows


def relevance(examples: Rows, toxic: np.ndarray, words: int) -> np.ndarray:
    """A factor for each word's weight: 1 + sqrt(G - CHANCE), G the log-likelihood ratio of the word's presence and the label, and 1 for words within chance.

    No word is left out. What insults a language has, or what marks toxic texts in it, is learnt from the labels alone.
    """
    n, bad = float(len(toxic)), float(toxic.sum())
    held = np.bincount(examples.terms, minlength=words).astype(np.float64)
    with_bad = np.bincount(examples.terms, toxic[examples.of()], minlength=words)
    g = np.zeros(words)
    for seen, expected in ((with_bad, held * bad / max(n, 1)), (held - with_bad, held * (n - bad) / max(n, 1)), (bad - with_bad, (n - held) * bad / max(n, 1)), (n - bad - held + with_bad, (n - held) * (n - bad) / max(n, 1))):
        there = seen > 0
        g[there] += 2 * seen[there] * np.log(seen[there] / expected[there])
    return 1 + np.sqrt(np.maximum(0.0, g - CHANCE))


def alike(dense: np.ndarray, rows: np.ndarray, block: int) -> list[int]:
    """rows in an order that puts alike ones side by side: halves along the main direction, and so on down to a block."""
    if len(rows) <= block:
        return rows.tolist()
    part = dense[rows] - dense[rows].mean(axis=0)
    direction = part[np.argmax((part * part).sum(axis=1))]
    for _ in range(4):
        direction = (part @ direction) @ part
        size = math.sqrt(float(direction @ direction))
        if not size:
            break
        direction = direction / size
    order = rows[np.argsort(np.round(part @ direction, 9), kind="stable")]
    half = block * (-(-len(rows) // block) // 2) or block
    return alike(dense, order[:half], block) + alike(dense, order[half:], block)


class BlockMaxIndex:
    """Unit vectors by term. Lists of many vectors are dense rows cut into blocks with their maxima, the others pairs of vector and weight."""

    def __init__(self, vectors: Rows, terms: int, block: int = BLOCK, long_list: int = LONG_LIST):
        n = len(vectors)
        held = np.bincount(vectors.terms, minlength=terms)
        self.n, self.block, self.blocks = n, block, -(-n // block)
        self.long = np.full(terms, -1, np.int64)  # the row of a long list
        often = np.flatnonzero(held > max(1, n // long_list))
        self.long[often] = np.arange(len(often))
        of, at = vectors.of(), self.long[vectors.terms]
        dense = np.zeros((n, len(often)))
        dense[of[at >= 0], at[at >= 0]] = vectors.weights[at >= 0]
        self.order = np.array(alike(dense, np.arange(n), block), np.int64)  # the vector at each place
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.place = place
        # Of each block the lists that stand in it, their part, and each list's largest weight there.
        self.most = np.zeros((len(often), self.blocks))
        self.there, self.parts = [], []
        for b in range(self.blocks):
            part = np.zeros((len(often), block))
            own = self.order[b * block : (b + 1) * block]
            part[:, : len(own)] = dense[own].T
            self.most[:, b] = part.max(axis=1)
            self.there.append(np.flatnonzero(self.most[:, b]))
            self.parts.append(part[self.there[-1]])
        del dense
        few = np.flatnonzero(at < 0)
        few = few[np.argsort(vectors.terms[few], kind="stable")]
        self.few_place, self.few_weight = place[of[few]].astype(np.int32), vectors.weights[few]
        self.few_ends = np.concatenate([[0], np.cumsum(np.bincount(vectors.terms[few], minlength=terms))])

    def similarities(self, asked: Rows, k: int, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each asked row the similarity to the vector at each place, -1 where it can't be among the k nearest, and the k-th largest.

        without: a place for each row that is no neighbour of it. Blocks are opened by their bounds; what isn't opened is below the k-th.
        """
        rows, width = len(asked), self.blocks * self.block
        of, at = asked.of(), self.long[asked.terms]
        known = np.zeros((rows, len(self.most)))
        known[of[at >= 0], at[at >= 0]] = asked.weights[at >= 0]
        few = at < 0
        low, count = self.few_ends[asked.terms[few]], np.diff(self.few_ends)[asked.terms[few]]
        entry = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
        sums = np.bincount(np.repeat(of[few], count) * width + self.few_place[entry], np.repeat(asked.weights[few], count) * self.few_weight[entry], minlength=rows * width)
        sums = sums[: rows * width].reshape(rows, width)
        sums[:, self.n :] = -2.0
        if without is not None:
            sums[np.arange(rows), without] = -2.0
        bound = sums.reshape(rows, self.blocks, self.block).max(axis=2) + known @ self.most
        out = np.full((rows, width), -1.0)
        k = min(k, self.n - (without is not None))
        if k < 1:
            return out, np.full(rows, np.inf)
        opened = np.zeros((rows, self.blocks), bool)
        first = min(self.blocks, -(-k // self.block) + 1)
        np.put_along_axis(opened, np.argpartition(-bound, first - 1, axis=1)[:, :first], True, axis=1)
        self._open(opened, known, sums, out)
        kth = np.partition(out, width - k, axis=1)[:, width - k]
        more = (bound >= kth[:, None] - 1e-9) & ~opened
        self._open(more, known, sums, out)
        return out, np.partition(out, width - k, axis=1)[:, width - k]

    def _open(self, which: np.ndarray, known: np.ndarray, sums: np.ndarray, out: np.ndarray) -> None:
        for b in np.flatnonzero(which.any(axis=0)).tolist():
            rows, own = np.flatnonzero(which[:, b]), slice(b * self.block, (b + 1) * self.block)
            out[rows, own] = np.maximum(-1.0, sums[rows, own] + known[rows[:, None], self.there[b]] @ self.parts[b])


def votes(similarity: np.ndarray, kth: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of toxic examples among the nearest, ties with the last included; 0 without neighbours."""
    weight = np.where(similarity >= np.maximum(kth, 0.0)[:, None] - 1e-9, np.maximum(similarity, 0.0) + 1e-9, 0.0)
    total = weight.sum(axis=1)
    return np.divide((weight @ toxic), total, out=np.zeros(len(total)), where=total > 0)


class Model:
    """Words, their weights, the index and the calibration; small enough to travel with the tasks."""

    def __init__(self, words: list[str], idf: np.ndarray, examples: Rows, names: list[str], toxic: np.ndarray, share: float = VOTERS_SHARE, least: int = LEAST_VOTERS):
        """examples: rows of term counts."""
        self.words, self.idf = words, idf * relevance(examples, toxic, len(words))
        vectors = unit_rows(examples.ends, examples.terms, examples.weights, self.idf)
        self.k = max(least, round(share * len(vectors)))
        self.index = BlockMaxIndex(vectors, len(words))
        self.names = [names[i] for i in self.index.order]
        self.toxic = np.zeros(self.index.blocks * self.index.block)
        self.toxic[: len(vectors)] = toxic[self.index.order]
        raw = [votes(*self.index.similarities(vectors.part(i, min(i + TOGETHER, len(vectors))), self.k, self.index.place[i : i + TOGETHER]), self.toxic) for i in range(0, len(vectors), TOGETHER)]
        self.slope, self.shift = platt(np.concatenate(raw) if raw else np.empty(0), toxic, np.ones(len(toxic)))

    def score(self, asked: Rows) -> tuple[np.ndarray, list[list[str]]]:
        """Scores of rows of term counts and the names of the nearest examples."""
        vectors = unit_rows(asked.ends, asked.terms, asked.weights, self.idf)
        similarity, kth = self.index.similarities(vectors, self.k)
        z = np.clip(self.slope * votes(similarity, kth, self.toxic) + self.shift, -30, 30)
        shown = min(SHOWN, self.index.n)
        near = np.argpartition(-similarity, shown - 1, axis=1)[:, :shown] if shown else np.empty((len(z), 0), int)
        rank = np.lexsort((near, -np.take_along_axis(similarity, near, axis=1)), axis=1) if shown else near
        names = [[self.names[j] for j in row if s[j] > 0] for row, s in zip(np.take_along_axis(near, rank, axis=1).tolist(), similarity)]
        return np.round(1 / (1 + np.exp(-z)), 9), names


def platt(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a little damping. Votes that tell nothing, or the wrong way, give the slope 0 and the share of toxic examples; without examples that counts as a quarter."""
    share = (label @ weight + 1) / (weight.sum() + 2) if len(raw) else 0.25
    flat = 0.0, math.log(share / (1 - share))
    if not len(raw) or label.min() == label.max():
        return flat
    x = np.stack([raw, np.ones_like(raw)], axis=1)
    beta = np.array([4.0, -2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - label)) + 0.01 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else flat


def _vectors(words: list[str], label: str = "text_hash") -> Callable:
    """Texts to the positions and counts of the model's words; (id, text, what is carried on as `label`)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(words)}
        for got in source:
            ends, terms, counts = array("i", [0]), array("i"), array("i")  # four bytes a number, not an object
            for text in got.column(1):
                for word, n in word_counts(text.as_py() or "").items():
                    if (i := at.get(word)) is not None:
                        terms.append(i)
                        counts.append(n)
                ends.append(len(terms))
            ends, terms, counts = (pa.array(np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32)) for x in (ends, terms, counts))
            lists = [pa.ListArray.from_arrays(ends, x) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(2), *lists], ["id", label, "idx", "tf"])

    return run


def _frequencies(terms: int) -> Callable:
    """Rows of positions to how many rows hold each, a sum for each partition."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(terms, np.int64)
        for got in source:
            held += np.bincount(got.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        at = np.flatnonzero(held)
        for low in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[low : low + 50_000], pa.int32()), pa.array(held[at[low : low + 50_000]])], ["t", "n"])

    return run


def _words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in source:
        for text in got.column(0).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(list(word_counts(text or "")), pa.string())], ["word"])


def _rows(got: pa.RecordBatch) -> Rows:
    """The columns idx and tf as rows of counts."""
    idx, tf = got.column(2), got.column(3)
    ends = np.concatenate([[0], np.cumsum(np.diff(idx.offsets.to_numpy()))]) if len(idx) else np.zeros(1, np.int64)
    return Rows(ends.astype(np.int64), idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64), tf.flatten().to_numpy(zero_copy_only=False).astype(np.float64))


def _scores(model: Model) -> Callable:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in source:
            for low in range(0, whole.num_rows, TOGETHER):
                got = whole.slice(low, TOGETHER)
                rows = _rows(got)
                score, near = model.score(rows)
                weights = (1 + np.log(rows.weights)) * model.idf[rows.terms]
                heavy = []
                for a, b in zip(rows.ends[:-1].tolist(), rows.ends[1:].tolist()):
                    own = np.lexsort((rows.terms[a:b], -weights[a:b]))[:SHOWN]
                    heavy.append([model.words[t] for t in rows.terms[a:b][own].tolist()])
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), pa.array(score), pa.array(heavy, pa.list_(pa.string())), pa.array(near, pa.list_(pa.string()))], ["id", "text_hash", "score", "evidence_terms", "evidence_examples"])

    return run


def training_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_EXAMPLES) -> DataFrame:
    """(id, toxic, text), ids as text, of at most `most` labelled documents, by a hash of the id; never one whose crc32 mod 5 is 0. One row for an id: toxic if any label says so, the first of its texts in their order."""
    usable = labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(F.crc32("id") % 5 != 0)
    picked = usable.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(most)
    found = docs.select(F.col("id").cast("string").alias("id"), "text").join(F.broadcast(picked.withColumnRenamed("id", "__id")), F.col("id") == F.col("__id"))
    return written(found.groupBy("id", "toxic").agg(F.min("text").alias("text")), "toxicity-examples")


def fit(sample: DataFrame, vectors_of: Callable[[list[str]], DataFrame]) -> tuple[Model, DataFrame]:
    """The model of the sampled (id, toxic, text) rows, and all documents' (id, text_hash, idx, tf) as a written table."""
    words = sorted(sample.select("text").mapInArrow(_words, "word string").distinct().toArrow().column(0).to_pylist())  # of the sample alone
    table = written(vectors_of(words), "toxicity-vectors")
    idf = np.full(len(words), math.log(1 + table.count()) + 1)
    held = table.select("idx").mapInArrow(_frequencies(len(words)), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()  # a row for each word at most
    idf[held.column(0).to_numpy()] -= np.log(1 + held.column(1).to_numpy())
    ordered = sample.select("id", "text", F.col("toxic").cast("long").alias("text_hash"))
    examples = ordered.mapInArrow(_vectors(words, "toxic"), "id string, toxic long, idx array<int>, tf array<int>").toArrow().combine_chunks().sort_by("id")
    batch = pa.RecordBatch.from_arrays([examples.column(i).combine_chunks() for i in range(4)], ["id", "toxic", "idx", "tf"])
    return Model(words, idf, _rows(batch), batch.column(0).to_pylist(), (batch.column(1).to_numpy() > 0).astype(np.float64)), table


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_examples: int = MOST_EXAMPLES) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted, evidence_terms, evidence_examples, text_hash.

    labels: (doc_id, toxic); null ids or labels are left out, contradicting ones count as toxic. held_out: crc32 of the
    id as text mod 5 is 0; such rows, and those with a null id (held_out false), teach nothing. Ids may be of any type
    that has a text form. A null or empty text, or one without a word of the examples, has no neighbours and gets the
    score of no toxic votes. Without labels all scores are 0.25, as there is nothing to reject by. predicted is 1 for
    scores of 0.5 or more. An empty table gives an empty result. evidence_terms: the text's heaviest words; evidence_examples: ids of its nearest.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(column(docs, id_col).alias("id"), text_of(column(docs, text_col)).alias("text"))
    sample = training_sample(base, labels, most_examples)
    model, table = fit(sample, lambda words: base.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_vectors(words), f"id {kind}, text_hash long, idx array<int>, tf array<int>"))
    scored = table.mapInArrow(_scores(model), f"id {kind}, text_hash long, score double, evidence_terms array<string>, evidence_examples array<string>")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    predicted = (F.col("score") >= 0.5).cast("int")
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", predicted.alias("predicted"), "evidence_terms", F.col("evidence_examples").cast(f"array<{kind}>").alias("evidence_examples"), "text_hash")


def clean_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    bad = toxicity(docs, labels, id_col, text_col, **options).where("predicted = 1").select(F.col(id_col).alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    bad = written(bad, "toxicity-rejected")
    same = column(docs, id_col).eqNullSafe(bad["__id"]) & (F.xxhash64(text_of(column(docs, text_col))) == bad["__hash"])
    return docs.join(small_or_not(bad, bad.count()), same, "left_anti")
