"""Nearest-neighbour graphs: edges src, dst, distance, rank. On equal distances the larger id is nearer."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simplicia.functions.distances import DEFAULT, Distance
from simplicia.functions.scalars import dimension, hashed_share
from simplicia.operators import lsh, pairs
from simplicia.sources.readers import with_index
from simplicia.storage import cut_lineage


def top_k(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every src, each neighbour once. Ranking stops at k in every task before rows move."""
    w = Window.partitionBy("src").orderBy("distance", F.desc("dst"))
    return edges.select("src", "dst", "distance").dropDuplicates(["src", "dst"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_knn(points: DataFrame, k: int, distance: Distance = DEFAULT) -> DataFrame:
    return top_k(pairs.nearest(points, k, distance), k)


def sampled_knn(points: DataFrame, k: int, distance: Distance = DEFAULT, amount: int | None = None, fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Exact neighbours, among all points, of the first ``amount`` points by index, or of a random share of them."""
    sample = points.orderBy("index").limit(amount) if amount is not None else points.where(hashed_share("index", seed) < fraction)
    return top_k(pairs.nearest(points, k, distance, of=sample), k)


def _closest(ids: np.ndarray, x: np.ndarray, k: int, distance: Distance, rows: int = 500) -> pd.DataFrame:
    """src, dst, distance of each point's k nearest among ``x``, by ``rows`` points at a time, so memory stays linear in ``x``."""
    out, k = [], min(k, len(ids) - 1)
    square = (x * x).sum(1)
    for at in range(0, len(ids) if k > 0 else 0, rows):
        y = x[at : at + rows]
        if distance.name == "euclidean":  # squares from inner products find candidates; their distances are taken exactly
            d, slack = square[at : at + rows, None] + square[None, :] - 2 * (y @ x.T), 1e-9 * max(1.0, float(square.max()))
        else:
            d, slack = distance.block(y, x), 0.0
        d[np.arange(len(y)), np.arange(at, at + len(y))] = np.inf
        r, c = np.nonzero(~(d > np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack))  # NaN is farthest
        keep = r + at != c
        r, c = r[keep], c[keep]
        found = np.sqrt(((y[r] - x[c]) ** 2).sum(1)) if distance.name == "euclidean" else d[r, c]
        order = np.lexsort((-ids[c], found, r))  # on a tie the larger id
        first = np.searchsorted(r, np.arange(len(y)))
        order = order[np.arange(len(r)) - first[r] < k]
        out.append(pd.DataFrame({"src": ids[at + r[order]], "dst": ids[c[order]], "distance": found[order]}))
    return pd.concat(out) if out else pd.DataFrame({"src": [], "dst": [], "distance": []})


@dataclass(frozen=True)
class Symmetry:
    """How a graph is made undirected; see :func:`symmetricize`."""

    weighted: bool = True
    mutual: bool = True
    halve: bool = False


@dataclass(frozen=True)
class FastParams:
    """Parameters of the approximate graph. ``jobs`` splits the tables into groups, each written before the next begins."""

    k: int = 50
    distance: Distance = DEFAULT
    tables: int = 5
    block: int = 100
    jobs: int = 1
    share: float = 0.0
    lsh: lsh.Params | None = None
    symmetry: Symmetry | None = None

    def exact(self) -> tuple[int, Distance]:
        """What the exact graph of the same neighbours takes."""
        return self.k, self.distance


def fast_graph(points: DataFrame, params: FastParams) -> DataFrame:
    """The approximate graph of ``params``: groups of tables one after the other, so that fewer copies of the points are under way, then symmetric if asked."""
    per_job = -(-params.tables // max(1, params.jobs))
    graph = None
    for first in range(0, params.tables, per_job):
        own = params.lsh or lsh.Params(distance=params.distance)
        one = fast_knn(points, params.k, params.distance, min(per_job, params.tables - first), params.block, own, share=params.share, first=first)
        one = cut_lineage(one) if params.jobs > 1 else one
        graph = one if graph is None else combine(graph, one, params.k)
    s = params.symmetry
    return graph if s is None else symmetricize(graph, s.weighted, s.mutual, s.halve)


def fast_knn(points: DataFrame, k: int = 50, distance: Distance = DEFAULT, tables: int = 5, block: int = 100, params: lsh.Params | None = None, seed: int = 0, share: float = 0.0, first: int = 0) -> DataFrame:
    """Approximate neighbours: in each table points are ordered by a random projection of their LSH signature, cut into blocks, and compared within one.

    A block holds ``block`` points or the ``share`` of all, whichever is more: among points without clusters, recall follows
    the share. Range partitions and running numbers place the points, so blocks are the same for any number of partitions,
    no task sees a whole table, and nothing goes to the driver."""
    params = params or lsh.Params(distance=distance, seed=seed)
    size, n = dimension(points), points.count()
    if not n:
        return points.sparkSession.createDataFrame([], "src long, dst long, distance double, rank int")
    blocks = max(1, n // max(block, math.ceil(share * n)))
    keys = []
    for t in range(first, first + tables):
        functions = lsh.hash_functions(params, size, seed=params.seed * 1009 + t)
        weights = np.random.default_rng(params.seed * 7919 + t).uniform(-1, 1, params.length)
        keys.append(sum((s * F.lit(float(w)) for s, w in zip(functions, weights, strict=True)), F.lit(0.0)))
    keyed = points.select("index", F.posexplode(F.array(*keys)).alias("table", "key"))
    placed = with_index(keyed, "table", "key", "index", name="at")  # every table has n rows
    placed = placed.select("index", "table", F.floor((F.col("at") - F.col("table") * n) * blocks / n).alias("block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _closest(pdf["index"].to_numpy(), np.stack(pdf["features"].to_list()).astype(float), k, distance)

    found = placed.join(points.select("index", "features"), "index").groupBy("table", "block").applyInPandas(run, "src long, dst long, distance double")
    return top_k(found, k)


def combine(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    return top_k(a.select("src", "dst", "distance").unionByName(b.select("src", "dst", "distance")), k)


def relative_accuracy(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row, ``accuracy``: mean share of a baseline point's neighbours that the candidate also has."""
    hits = baseline.select("src", "dst").join(candidate.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return hits.groupBy("src").agg((F.count("hit") / F.count("*")).alias("share")).agg(F.avg("share").alias("accuracy"))


def symmetricize(graph: DataFrame, weighted: bool = True, mutual: bool = False, halve: bool = False) -> DataFrame:
    """An undirected graph, both directions of each edge: those seen from both ends (``mutual``) or from either.

    Weights are distances, or 1; ``halve`` halves the distance of edges seen from one end only."""
    both = graph.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("n"), F.min("distance").alias("d"))
    if mutual:
        both = both.where("n > 1")
    weight = F.when((F.col("n") == 1) & F.lit(halve), F.col("d") / 2).otherwise(F.col("d")) if weighted else F.lit(1.0)
    ways = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return both.select(ways.alias("e"), weight.alias("distance")).select("e.src", "e.dst", "distance")
