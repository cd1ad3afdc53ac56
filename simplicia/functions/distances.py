"""Distances between feature arrays: a Column builder for plans and a numpy twin for blocks of points."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def non_zero(a: Column) -> Column:
    """Positions of the features that aren't zero."""
    return F.filter(F.transform(a, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())


@dataclass(frozen=True)
class Distance:
    """``column(a, b)`` of two array columns; ``block(x, y)`` of two matrices of rows gives all distances between them."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]


def _by_row(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """One row of x against all of y at a time: memory stays at one block."""
    return lambda x, y: np.stack([f(np.abs(y - row)) for row in x]) if len(x) else np.zeros((0, len(y)))


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return 1 - (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def _tanimoto(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    inner = x @ y.T
    below = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - inner
    return 1 - np.divide(inner, below, out=np.ones_like(inner), where=below != 0)


def _jaccard(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a, b = (x != 0).astype(float), (y != 0).astype(float)
    both = a @ b.T
    union = a.sum(1)[:, None] + b.sum(1)[None, :] - both
    return 1 - np.divide(both, union, out=np.ones_like(both), where=union != 0)


EUCLIDEAN = Distance("euclidean", lambda a, b: F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y))), _by_row(lambda d: np.sqrt((d * d).sum(1))))
MANHATTAN = Distance("manhattan", lambda a, b: _fold(a, b, lambda x, y: F.abs(x - y)), _by_row(lambda d: d.sum(1)))
CHEBYSHEV = Distance("chebyshev", lambda a, b: F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), _by_row(lambda d: d.max(1)))
COSINE = Distance("cosine", lambda a, b: _cosine_column(a, b), _cosine)


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(1, keepdims=True)


def _ranked(x: np.ndarray) -> np.ndarray:
    """Ranks from 0 within each row, the mean rank for equals."""
    below = (x[:, None, :] < x[:, :, None]).sum(2)
    same = (x[:, None, :] == x[:, :, None]).sum(2)
    return below + (same - 1) / 2


def _mean_of(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _minus_mean(a: Column) -> Column:
    return F.transform(a, lambda x: x - _mean_of(a))


def _ranks(a: Column) -> Column:
    count = lambda test: F.size(F.filter(a, test)).cast("double")
    return F.transform(a, lambda x: count(lambda y: y < x) + (count(lambda y: y == x) - 1) / 2)


def _cosine_column(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


PEARSON = Distance("pearson", lambda a, b: _cosine_column(_minus_mean(a), _minus_mean(b)), lambda x, y: _cosine(_centred(x), _centred(y)))
SPEARMAN = Distance("spearman", lambda a, b: _cosine_column(_minus_mean(_ranks(a)), _minus_mean(_ranks(b))), lambda x, y: _cosine(_centred(_ranked(x)), _centred(_ranked(y))))
TANIMOTO = Distance(
    "tanimoto", lambda a, b: 1 - F.coalesce(dot(a, b) / F.nullif(dot(a, a) + dot(b, b) - dot(a, b), F.lit(0.0)), F.lit(1.0)), _tanimoto
)
JACCARD = Distance(
    "jaccard",
    lambda a, b: 1 - F.coalesce(F.size(F.array_intersect(non_zero(a), non_zero(b))) / F.nullif(F.size(F.array_union(non_zero(a), non_zero(b))), F.lit(0)), F.lit(1.0)),
    _jaccard,
)


def minkowski(p: float) -> Distance:
    """The p-th root of the sum of p-th powers; with p below 1 it is still the same formula, though no metric."""
    if p <= 0:
        raise ValueError("p must be positive")
    return Distance(f"minkowski({p:g})", lambda a, b: F.pow(_fold(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p))), F.lit(1 / p)), _by_row(lambda d: (d**p).sum(1) ** (1 / p)))


lp_norm = minkowski
DEFAULT = MANHATTAN
NAMED = {d.name: d for d in (EUCLIDEAN, MANHATTAN, CHEBYSHEV, COSINE, PEARSON, SPEARMAN, TANIMOTO, JACCARD)}


def distance_matrix(x: np.ndarray, distance: Distance = DEFAULT) -> np.ndarray:
    """All distances among a few rows, with zeros on the diagonal."""
    x = np.asarray(x, float)
    out = np.empty((len(x), len(x)))
    for k in range(0, len(x), 256):  # a few rows at a time, so that there is one matrix, and each pair once
        out[k : k + 256, k:] = distance.block(x[k : k + 256], x[k:])
        out[k:, k : k + 256] = out[k : k + 256, k:].T
    np.fill_diagonal(out, 0)
    return out
