"""Spectral geometry of a neighbour graph: affinities, degrees, normalised matrix, embedding."""

from __future__ import annotations

import math

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.mllib.linalg import SparseVector, VectorUDT
from pyspark.mllib.linalg.distributed import IndexedRowMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from simplicia.functions.distances import TANIMOTO, Distance
from simplicia.functions.scalars import gaussian_similarity
from simplicia.operators import pairs
from simplicia.sources.readers import with_index
from simplicia.storage import cut_lineage

#: Columns of an embedding, at most.
COLUMNS = 10
#: Of the solver by products: columns of features it starts from, random ones beside them, columns that the driver holds, residual of a vector as a share of its value, products.
START, GUARD, HELD, SMALL, PRODUCTS = 64, 4, 64, 1e-9, 300


def affinities(graph: DataFrame, sigma: float = 1.0, k: int | None = None) -> DataFrame:
    """i, j, value: Gaussian similarity of the graph's edges, of the k nearest of each point if k is given."""
    if k is not None:
        w = Window.partitionBy("src").orderBy("distance", F.desc("dst"))
        graph = graph.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= k)
    return graph.select(F.col("src").alias("i"), F.col("dst").alias("j"), gaussian_similarity(F.col("distance"), sigma).alias("value"))


def degrees(matrix: DataFrame, power: float = 1.0) -> DataFrame:
    return matrix.groupBy("i").agg(F.pow(F.sum("value"), F.lit(power)).alias("degree"))


def normalised(matrix: DataFrame) -> DataFrame:
    """D^-1/2 A D^-1/2 with row sums as degrees; entries at points without a row drop out. Two joins, no local matrix."""
    d = degrees(matrix, -0.5)
    left, right = d.withColumnRenamed("degree", "di"), d.select(F.col("i").alias("j"), F.col("degree").alias("dj"))
    return matrix.join(left, "i").join(right, "j").select("i", "j", (F.col("value") * F.col("di") * F.col("dj")).alias("value"))


def embedding(matrix: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """index, values: leading left singular vectors of the normalised matrix, rows of unit length, largest entry of a column positive.

    A matrix without entries has no rows."""
    return _unit_rows(singular_vectors(normalised(matrix), columns))


def _unit_rows(vectors: DataFrame) -> DataFrame:
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = F.transform("v", lambda x: F.when(F.col("length") > 0, x / F.col("length")).otherwise(0.0))
    return vectors.withColumnRenamed("values", "v").withColumn("length", length).select("index", unit.alias("values"))


def singular_vectors(matrix: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """index, values: leading left singular vectors of a symmetric matrix (i, j, value), largest entry of a column positive.

    The solver is mllib's: rows are spread, vectors of one number a row are the driver's. An empty matrix has no rows."""
    ids = matrix.select(F.col("i").alias("id")).union(matrix.select("j")).distinct()
    numbers = cut_lineage(with_index(ids, "id", name="n"))
    n = numbers.count()
    if not n:
        return matrix.sparkSession.createDataFrame([], "index long, values array<double>")
    k = min(COLUMNS, n)  # fewer make the solver fail now and then
    placed = matrix.join(numbers.select(F.col("id").alias("i"), F.col("n").alias("r")), "i").join(numbers.select(F.col("id").alias("j"), F.col("n").alias("c")), "j")
    lines = placed.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("cells")).select("r", "cells.c", "cells.value")
    # vectors are made once, in Python, and kept, as the solver reads all rows in each of its many steps
    made = lines.rdd.map(lambda r: (r[0], SparseVector(n, r[1], r[2])))
    rows = matrix.sparkSession.createDataFrame(made, StructType([StructField("index", LongType()), StructField("vector", VectorUDT())])).persist()
    u = IndexedRowMatrix(rows, n, n).computeSVD(k, computeU=True).U
    frame = matrix.sparkSession.createDataFrame(u.rows.map(lambda r: (int(r.index), r.vector.toArray().tolist())), "n long, u array<double>").persist()
    first = frame.first()
    width = min(columns, len(first["u"])) if first else 0
    tops = frame.agg(*(F.max_by(F.signum(F.col("u")[j]), F.struct(F.round(F.abs(F.col("u")[j]), 9), -F.col("n"))) for j in range(width))).first()
    rows.unpersist()
    turned = F.array(*(F.col("u")[j] * F.lit(float(tops[j] or 1.0)) for j in range(width)))
    return frame.join(numbers, "n").select(F.col("id").alias("index"), turned.alias("values"))


def _defined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Tanimoto distances, NaN where the denominator is zero: between two points that are zero everywhere."""
    return np.where(np.logical_and.outer(~x.any(1), ~y.any(1)), np.nan, TANIMOTO.block(x, y))


def tanimoto_affinities(points: DataFrame) -> DataFrame:
    """i, j, value: Gaussian similarity of the Tanimoto distance of all pairs, both ways, so always positive.

    No point meets itself, and pairs of zero denominator have no entry."""
    edges = pairs.distances(points, Distance(TANIMOTO.name, TANIMOTO.column, _defined), below=math.inf)  # NaN isn't below
    one = edges.select("src", "dst", gaussian_similarity(F.col("distance")).alias("value"))
    return one.select(F.col("src").alias("i"), F.col("dst").alias("j"), "value").unionByName(one.select(F.col("dst").alias("i"), F.col("src").alias("j"), "value"))


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same of two blocks, 0 for pairs without an entry."""
    a, b = (x * x).sum(1), (y * y).sum(1)
    if not (np.isfinite(a).all() and np.isfinite(b).all() and (a.all() or b.all())):
        d = _defined(x, y)
        return np.nan_to_num(np.exp(-d * d / 2))
    tile = x @ y.T
    below = a[:, None] + b[None, :]
    below -= tile
    tile /= below
    tile -= 1
    tile *= tile
    tile *= -0.5
    return np.exp(tile, out=tile)


def tanimoto_vectors(points: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """index, values: what :func:`singular_vectors` gives of the normalised :func:`tanimoto_affinities`, without making that matrix.

    Points that have no entry have no row. The driver keeps vectors of one number a point, ``HELD`` of them and their products at most."""
    spark = points.sparkSession
    numbers = cut_lineage(with_index(points.select("index", "features"), "index", name="n"))
    n = numbers.count()
    empty = spark.createDataFrame([], "index long, values array<double>")
    if not n:
        return empty
    blocks = pairs.pack(numbers)
    start = _start(blocks, n, columns)
    wide = blocks.join(pairs.multiply_made(blocks, n, _similar, start), blocks.getNumPartitions()).map(lambda b: (b[0], (start(b[0], b[1][0]), b[1][1]))).persist(StorageLevel.MEMORY_AND_DISK)
    degree = np.concatenate([d for _, d in sorted(wide.mapValues(lambda b: b[1][:, 0] / b[0][:, 0]).collect(), key=lambda b: b[0])])
    if not (degree > 0).all():
        wide.unpersist()
        alone = spark.createDataFrame([(int(i),) for i in np.flatnonzero(degree <= 0)], "n long")
        return tanimoto_vectors(numbers.join(alone, "n", "left_anti"), columns) if (degree > 0).any() else empty
    u = _leading(lambda v: pairs.multiply(blocks, _similar, v), wide, np.sqrt(degree)[:, None], columns)
    wide.unpersist()
    tops = np.abs(u).round(9).argmax(0)
    u = u * np.where(u[tops, np.arange(u.shape[1])] < 0, -1.0, 1.0)
    parts = [(k, u[k : k + pairs.PACKED]) for k in range(0, n, pairs.PACKED)]
    rows = spark.sparkContext.parallelize(parts, min(len(parts), spark.sparkContext.defaultParallelism)).flatMap(lambda p: [(p[0] + k, v.tolist()) for k, v in enumerate(p[1])])
    return spark.createDataFrame(rows, "n long, values array<double>").join(numbers, "n").select("index", "values")


def _start(blocks: RDD, n: int, columns: int):
    """What makes a block's rows of the first columns: equal numbers; all there can be of few points, else features (or mixtures of them) and random ones.

    Features are near the vectors that are sought, since similarity is close to linear in the inner product. The leading
    vector of a normalised matrix is known beforehand, so it alone needs none."""
    if n <= pairs.PACKED:
        all_of_them = np.linalg.qr(np.column_stack([np.ones(n), np.random.default_rng(0).normal(size=(n, n - 1))]))[0]
        return lambda p, x: all_of_them
    d = blocks.first()[1].shape[1] if columns > 1 else 0
    mix = np.random.default_rng(0).normal(size=(d, START)) if d > START else np.eye(d)
    finite = lambda x: np.where(np.isfinite(x), x, 0.0)
    top = blocks.map(lambda b: np.abs(finite(b[1])).max(initial=0.0)).max() or 1.0
    return lambda p, x: np.column_stack([np.ones(len(x)), finite(x[:, :d]) / top @ mix, np.random.default_rng(p).normal(size=(len(x), GUARD))])


def _leading(multiply, wide: RDD, root: np.ndarray, columns: int) -> np.ndarray:
    """Leading singular vectors of D^-1/2 A D^-1/2, in columns: Rayleigh and Ritz on a basis that residuals extend until they are ``SMALL``.

    ``multiply`` is by A, ``root`` the roots of the degrees. ``wide`` has each block's rows of the first columns and of A times
    them, which stay where they are; the driver has the others and their products. Of two values of one size the positive comes first."""

    def cut(x):
        return [x[k : k + pairs.PACKED] for k in range(0, len(x), pairs.PACKED)]

    def met(x):  # the first columns' inner products with others
        sent = wide.context.broadcast(cut(x))
        out = first.map(lambda b: b[1][0].T @ sent.value[b[0]]).reduce(np.add)
        sent.destroy()
        return out

    def turned(a, b):  # mixtures of all columns, and of their products
        if not m:
            return own @ b, image @ b
        parts = sorted(first.mapValues(lambda x: (x[0] @ a, x[1] @ a)).collect(), key=lambda x: x[0])
        return np.concatenate([x for _, (x, _) in parts]) + own @ b, np.concatenate([y for _, (_, y) in parts]) + image @ b

    roots = wide.context.broadcast(cut(root))
    first = wide.map(lambda b: (b[0], (b[1][0] * roots.value[b[0]], b[1][1] / roots.value[b[0]])))
    g, h = np.split(first.map(lambda b: np.hstack([b[1][0].T @ b[1][0], b[1][0].T @ b[1][1]])).reduce(np.add), 2, axis=1)
    m, own, image = len(g), np.empty((len(root), 0)), np.empty((len(root), 0))
    for _ in range(PRODUCTS):
        scale = 1 / np.sqrt(np.where(np.diag(g) > 0, np.diag(g), np.inf))
        share, axes = np.linalg.eigh(g * scale * scale[:, None])
        plain = scale[:, None] * axes[:, share > 1e-6] / np.sqrt(share[share > 1e-6])  # of columns that say the same, one stays
        small = plain.T @ h @ plain
        value, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.lexsort((-value, -np.abs(value).round(12)))
        value, turn = value[order], plain @ turn[:, order]
        u, v = turned(turn[:m, : columns + GUARD], turn[m:, : columns + GUARD])
        rest = v - u * value[: columns + GUARD]
        large = np.sqrt((rest * rest).sum(0)) > np.maximum(SMALL * np.abs(value[: columns + GUARD]), 1e-12)
        if len(value) == len(root) or not large[:columns].any():
            return u[:, :columns]
        if own.shape[1] + large.sum() > HELD:
            own, image = turned(turn[:m, : HELD // 2], turn[m:, : HELD // 2])
            m, g, h = 0, own.T @ own, own.T @ image
        more = np.linalg.qr(rest[:, large])[0]
        product = multiply(more / root) / root
        beside = np.hsplit(met(np.hstack([more, product])), 2) if m else [np.empty((0, more.shape[1]))] * 2
        across = [np.vstack([beside[0], own.T @ more]), np.vstack([beside[1], own.T @ product])]
        g = np.block([[g, across[0]], [across[0].T, more.T @ more]])
        h = np.block([[h, across[1]], [across[1].T, more.T @ product]])
        own, image = np.hstack([own, more]), np.hstack([image, product])
    raise RuntimeError(f"vectors have not settled in {PRODUCTS} products")


def tanimoto_embedding(points: DataFrame, columns: int = COLUMNS) -> DataFrame:
    """index, values: :func:`embedding` of the Tanimoto affinities."""
    return _unit_rows(tanimoto_vectors(points, columns))


def local_embedding(matrix: np.ndarray, k: int) -> np.ndarray:
    """The same of a small dense matrix, to check the distributed one against."""
    d = 1 / np.sqrt(matrix.sum(1))
    u, *_ = np.linalg.svd(matrix * d[:, None] * d[None, :])
    u = u[:, :k]
    return u / np.sqrt((u * u).sum(1))[:, None]
