"""Lens functions: one double for each point.

A row-local lens is a column expression; others are a DataFrame (index, value). ``key`` names what a session may reuse:
all components of one decomposition share a key.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.functions.distances import DEFAULT, Distance
from simplicia.functions.scalars import dimension
from simplicia.operators import pairs


@dataclass(frozen=True)
class Lens:
    """A lens without a column of its own."""

    def column(self) -> Column | None:
        return None

    def frame(self, points: DataFrame, knn=None) -> DataFrame:
        """index, value; row-local lenses need no other point."""
        return points.select("index", self.column().alias("value"))

    def key(self):
        return self

    def graph(self) -> str | None:
        """Name of the distance whose neighbour graph the lens reads, if it reads one."""
        return None


@dataclass(frozen=True)
class Meta(Lens):
    name: str

    def column(self):
        return F.col(self.name).cast("double")


@dataclass(frozen=True)
class Feature(Lens):
    n: int

    def column(self):
        return F.col("features")[self.n]


@dataclass(frozen=True)
class FeatureMin(Lens):
    def column(self):
        return F.array_min("features")


@dataclass(frozen=True)
class FeatureMax(Lens):
    def column(self):
        return F.array_max("features")


def _mean() -> Column:
    return F.aggregate("features", F.lit(0.0), lambda s, x: s + x) / F.size("features")


@dataclass(frozen=True)
class FeatureMean(Lens):
    def column(self):
        return _mean()


@dataclass(frozen=True)
class FeatureVariance(Lens):
    """Sample variance."""

    def column(self):
        squares = F.aggregate(F.transform("features", lambda x: (x - _mean()) * (x - _mean())), F.lit(0.0), lambda s, x: s + x)
        return squares / (F.size("features") - 1)


@dataclass(frozen=True)
class FeatureStDev(Lens):
    def column(self):
        return F.sqrt(FeatureVariance().column())


@dataclass(frozen=True)
class Eccentricity(Lens):
    """n = inf: the largest distance to another point; n = 1: the sum of distances over N; else the n-th root of the sum of powers, over N."""

    n: float
    distance: Distance = DEFAULT

    def frame(self, points, knn=None):
        if self.n == math.inf:
            return pairs.aggregate(points, self.distance, lambda d: d, "max")
        if self.n < 1 or self.n != int(self.n):
            raise ValueError("eccentricity takes a whole number from 1, or infinity")
        n = int(self.n)
        sums = pairs.aggregate(points, self.distance, (lambda d: d) if n == 1 else lambda d: d**n)
        return sums.select("index", ((F.col("value") if n == 1 else F.pow("value", F.lit(1 / n))) / points.count()).alias("value"))


@dataclass(frozen=True)
class Density(Lens):
    """Sum over other points of exp(-d^2 / 2 sigma^2), not normalised."""

    sigma: float = 1.0
    distance: Distance = DEFAULT

    def frame(self, points, knn=None):
        s = 2 * self.sigma**2
        return pairs.aggregate(points, self.distance, lambda d: np.exp(-d * d / s))


@dataclass(frozen=True)
class PrincipalComponent(Lens):
    """n-th coordinate of the projection on principal components; each component's largest loading is made positive."""

    n: int
    k: int = 10

    def key(self):
        return PrincipalComponent(-1, self.k)

    def all(self, points: DataFrame) -> DataFrame:
        """index and values, the array of all coordinates; one fit serves every n."""
        d = dimension(points)
        if not d:
            return points.sparkSession.createDataFrame([], "index long, values array<double>")
        k = min(self.k, d)
        vectors = points.select("index", "features", array_to_vector("features").alias("v"))
        loadings = PCA(k=k, inputCol="v", outputCol="p").fit(vectors).pc.toArray()
        loadings = loadings * np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
        inner = lambda w: F.aggregate(F.zip_with("features", F.array(*map(F.lit, w.tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return vectors.select("index", F.array(*(inner(loadings[:, j]) for j in range(k))).alias("values"))

    def frame(self, points, knn=None):
        return self.all(points).select("index", F.col("values")[self.n].alias("value"))


@dataclass(frozen=True)
class LaplacianEigenVector(Lens):
    """n-th column of the spectral embedding of the neighbour graph, or of all points' Tanimoto affinities."""

    n: int
    k: int | None = None
    sigma: float = 1.0
    distance: Distance = DEFAULT

    def key(self):
        return LaplacianEigenVector(-1, self.k, self.sigma, self.distance)

    def graph(self):
        return None if self.distance.name == "tanimoto" else self.distance.name

    def all(self, points, knn=None):
        from simplicia.operators import laplacian

        if self.distance.name == "tanimoto":
            return laplacian.tanimoto_embedding(points)
        if knn is None:
            raise ValueError("this lens needs a neighbour graph of its distance")
        return laplacian.embedding(laplacian.affinities(knn, self.sigma, self.k))

    def frame(self, points, knn=None):
        return self.all(points, knn).select("index", F.col("values")[self.n].alias("value"))


@dataclass(frozen=True)
class Sketched(Lens):
    """Another lens evaluated on a sketch: points of one signature share the value of their prototype.

    Lenses over all pairs thereby cost what the prototypes cost; ``params`` and ``prototype`` as :func:`lsh.sketch` takes them."""

    lens: Lens
    params: object
    prototype: object = "mean"

    def frame(self, points, knn=None):
        from simplicia.operators import lsh
        from simplicia.sources.readers import with_index
        from simplicia.storage import cut_lineage

        sketched = cut_lineage(lsh.sketch(points, self.params, self.prototype))
        small = with_index(sketched.select("prototype", "features"), "prototype")
        values = self.lens.frame(small.select(F.col("index").cast("long").alias("index"), "features"), knn)
        named = values.join(small.select("index", "prototype"), "index").select("prototype", "value")
        return lsh.lookup(sketched).join(named, "prototype").select("index", "value")


@dataclass(frozen=True, eq=False)
class Custom(Lens):
    """Any DataFrame of index and value."""

    name: str
    values: DataFrame

    def frame(self, points, knn=None):
        return self.values.select("index", F.col("value").cast("double").alias("value"))

    def key(self):
        return (self.name, id(self.values))


