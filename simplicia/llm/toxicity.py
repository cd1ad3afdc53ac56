"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w . x - theta_k): one weight vector for all ordered thresholds. The expected severity is the sum
of these probabilities over k. Features are log(1 + occurrences) of words (letters only, ASCII case dropped) and of
their beginnings, which stand for stems, chosen for how their document frequencies differ between grades; most weights
end at zero under an L1 penalty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import Cache, fold, text_rows, workers, write_table

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
#: Features that may get a weight, at most, documents of the sample that must hold one, and its least log likelihood ratio.
FEATURES, LEAST_DOCS, LEAST_RATIO = 1000, 5, 14.0
#: Characters of the beginnings that are features.
STEMS = (5, 6, 7, 8)
PENALTY = 5e-5
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def word_list(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


def features(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, marked by a hyphen; a long word has beginnings only."""
    text = word.decode("utf-8", "replace")
    out = [text[:k].encode() + b"-" for k in STEMS if len(text) > k]
    return [word, *out] if len(text) <= 32 else out


def counted(text: str, found: Cache) -> Counter:
    """Occurrences of features; ``found`` has those of each word."""
    out: Counter = Counter()
    for word, n in Counter(word_list(text)).items():
        for f in found[word]:
            out[f] += n
    return out


@dataclass(frozen=True)
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: tuple[float, ...]

    def finder(self) -> Cache:
        return Cache(lambda word: tuple(f for f in features(word) if f in self.weights))

    def above(self, text: str, found: Cache | None = None) -> list[float]:
        """P(grade > k) for every threshold."""
        count = counted(text, found or self.finder())
        f = sum(self.weights[w] * math.log1p(count[w]) for w in sorted(count))
        return [float(1 / (1 + np.exp(t - f))) for t in self.thresholds]


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_features: int, n_grades: int, penalty: float = PENALTY, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds by proximal gradient steps (Adam) on the ordinal likelihood. rows: (features, values) of each document."""
    n = len(rows)
    at = np.concatenate([np.full(len(i), r) for r, (i, _) in enumerate(rows)] or [np.empty(0)]).astype(np.int64)
    index = np.concatenate([i for i, _ in rows] or [np.empty(0)]).astype(np.int64)
    value = np.concatenate([v for _, v in rows] or [np.empty(0)])
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1 / (2 * n + 2), 1 - 1 / (2 * n + 2))
    theta = np.log((1 - share) / share)
    gaps = np.log(np.maximum(np.diff(theta), 1e-2))
    w, params = np.zeros(n_features), np.concatenate([theta[:1], gaps])
    m, s = np.zeros(n_features + len(params)), np.zeros(n_features + len(params))
    for step in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate([params[:1], np.exp(params[1:])]))
        f = np.bincount(at, weights=w[index] * value, minlength=n)
        upper = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(theta - f[:, None], -50, 50))), np.zeros((n, 1))], axis=1)  # P(grade >= k)
        hi, lo = upper[np.arange(n), grades], upper[np.arange(n), grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        df = -(dhi - dlo) / n
        dtheta = np.array([(dhi[grades == k + 1].sum() - dlo[grades == k].sum()) / n for k in range(n_grades - 1)])
        grad = np.concatenate([np.bincount(index, weights=df[at] * value, minlength=n_features), [dtheta.sum()], [dtheta[k:].sum() * np.exp(params[k]) for k in range(1, len(params))]])
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad**2
        scale = 0.05 / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        move = scale * m / (1 - 0.9**step)
        w = w - move[:n_features]
        limit = 0.05 * penalty / (np.sqrt(s[:n_features] / (1 - 0.999**step)) + 1e-8)
        w = np.sign(w) * np.maximum(np.abs(w) - limit, 0)
        params = params - move[n_features:]
    return w, np.cumsum(np.concatenate([params[:1], np.exp(params[1:])]))


def _document_counts(docs: DataFrame) -> DataFrame:
    """grade, word, n: documents of each grade that hold a feature; ``docs`` has text and grade."""

    def run(batches):
        count: Counter = Counter()
        own = Cache(features, limit=200_000)

        def rows():
            keys = list(count)
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in keys], pa.int32()), pa.array([w for _, w in keys], pa.binary()), pa.array([count[k] for k in keys], pa.int64())], names=["grade", "word", "n"])
            count.clear()

        for batch in batches:
            for text, grade in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count.update((grade, f) for f in {f for w in set(word_list(text)) for f in own[w]})
                if len(count) > 300_000:
                    yield from rows()
        yield from rows()

    return docs.select("text", "grade").mapInArrow(run, "grade int, word binary, n long").groupBy("grade", "word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, grade: str = "toxic", parts: int = 5, held: int = 0, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows outside the held-out fold.

    ``grade`` is a column of whole numbers from 0. If it has only 0 and 1, grade 1 is divided by how much of the
    evidence a text holds: 2 for more occurrences of telling words than the median of grade 1, so three grades share the
    weights. Rows without doc_id or grade are no examples; of repeated labels the largest counts."""
    workers(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).dropna().where((fold("doc_id", parts) != held) & (F.col("grade") >= 0))
    chosen = marked.groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = write_table(text_rows(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade"), "toxicity-sample")

    sizes = {r[0]: r[1] for r in rows.groupBy("grade").count().collect()}  # a row for each grade
    if len(sizes) < 2:
        return OrdinalModel({}, (20.0,) if not sizes or 0 in sizes else (-20.0,))
    total = sum(sizes.values())
    clean = sizes.get(0, 0)
    by_word = _document_counts(rows).groupBy("word").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("grade") > 0, F.col("n")).otherwise(0)).alias("n1")).where(F.col("n") >= LEAST_DOCS)
    # log likelihood ratio of the documents that hold the feature against the share of grades above 0 in all
    n, n1, p = F.col("n"), F.col("n1"), (total - clean) / total
    term = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    ratio = (term(n1, n * p) + term(n - n1, n * (1 - p))) * F.signum(n1 - n * p)
    top = by_word.select("word", ratio.alias("g")).where(F.abs("g") >= LEAST_RATIO).orderBy(F.desc(F.abs("g")), "word").limit(FEATURES).collect()  # at most FEATURES rows
    place = {bytes(r.word): i for i, r in enumerate(top)}
    telling = {bytes(r.word) for r in top if r.g > 2 * LEAST_RATIO}

    def vectors(batches):
        found = Cache(lambda word: tuple(f for f in features(word) if f in place), limit=200_000)
        for batch in batches:
            ids, values, told = [], [], []
            for text in batch.column(0).to_pylist():
                count = counted(text, found)
                own = sorted((place[w], c) for w, c in count.items())
                ids.append([i for i, _ in own])
                values.append([float(np.log1p(c)) for _, c in own])
                told.append(sum(count[w] for w in telling & count.keys()))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), pa.array(told, pa.int64())], names=["doc_id", "grade", "ids", "values", "told"])

    sampled = rows.select("text", "doc_id", "grade").mapInArrow(vectors, "doc_id long, grade int, ids array<int>, values array<double>, told long")
    # of rows that share a doc_id the one of the least features is the example, so there are at most ``sample``
    sampled = sampled.groupBy("doc_id").agg(F.min(F.struct("grade", "ids", "values", "told")).alias("s")).select("doc_id", "s.*")
    got = sorted(sampled.collect(), key=lambda r: r.doc_id)
    grades = np.array([r.grade for r in got])
    if grades.max() == 1 and len(more := [r.told for r in got if r.grade]):
        grades = np.where((grades == 1) & (np.array([r.told for r in got]) > np.median(more)), 2, grades)
    levels = int(grades.max()) + 1
    w, theta = fit_ordinal([(np.array(r.ids), np.array(r.values)) for r in got], grades, len(place), levels)
    return OrdinalModel({k: float(w[i]) for k, i in place.items() if w[i]}, tuple(float(t) for t in theta))


def score_toxicity(docs: DataFrame, model: OrdinalModel, parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, expected_severity, toxic_probability, grade (most likely), toxic of every whole text.

    Null text: empty, no features. Null doc_id: kept, not held out. Repeated rows: each on its own. Empty table: no
    rows. Other columns are ignored."""
    workers(docs.sparkSession)

    def run(batches):
        found = model.finder()
        for batch in batches:
            above = [model.above(t, found) for t in batch.column(1).to_pylist()]
            grades = []
            for p in above:
                edges = [1.0, *p, 0.0]
                own = [edges[k] - edges[k + 1] for k in range(len(edges) - 1)]
                grades.append(max(range(len(own)), key=lambda k: (own[k], -k)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([sum(p) for p in above], pa.float64()), pa.array([p[0] for p in above], pa.float64()), pa.array(grades, pa.int32()), pa.array([p[0] >= 0.5 for p in above], pa.bool_())],
                names=["doc_id", "held_out", "expected_severity", "toxic_probability", "grade", "toxic"],
            )

    rows = text_rows(docs).withColumn("held_out", F.coalesce(fold("doc_id", parts) == held, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, expected_severity double, toxic_probability double, grade int, toxic boolean")
