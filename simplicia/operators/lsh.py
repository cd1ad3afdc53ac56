"""Locality-sensitive signatures as column expressions, and sketches of large inputs by equal signatures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.functions.distances import DEFAULT, Distance, distance_matrix
from simplicia.functions.scalars import dimension, hashed_share


@dataclass(frozen=True)
class Params:
    length: int = 10
    radius: float = 10.0
    distance: Distance = DEFAULT
    seed: int = 0


def hash_functions(params: Params, size: int, seed: int | None = None) -> list[Column]:
    """One column for each place of the signature: signs of Gaussian projections for cosine, buckets of Gaussian ones for
    Euclidean and of Cauchy ones for Manhattan and root-sum-of-powers distances."""
    rng = np.random.default_rng(params.seed if seed is None else seed)
    name = params.distance.name
    stable = name == "manhattan" or name.startswith("minkowski")
    if not stable and name not in ("cosine", "euclidean"):
        raise ValueError(f"no hash family for {name}")
    out = []
    for _ in range(params.length):
        w = rng.standard_cauchy(size) if stable else rng.standard_normal(size)
        shift = float(rng.uniform(0, params.radius))
        inner = F.aggregate(F.zip_with("features", F.array(*map(F.lit, w.tolist())).cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        out.append((inner >= 0).cast("double") if name == "cosine" else F.floor((inner + shift) / params.radius).cast("double"))
    return out


def signature(params: Params, size: int) -> Column:
    return F.array(*hash_functions(params, size))


def signature_id(params: Params, size: int) -> Column:
    """A number of 60 bits for a signature, from the MD5 of its whole numbers."""
    text = F.array_join(F.transform(signature(params, size), lambda x: x.cast("long").cast("string")), ",")
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: What makes a prototype: takes rows of index, features and prototype (the signature's id), returns prototype and features.
Strategy = Callable[[DataFrame], DataFrame]


def random_candidate(seed: int = 0) -> Strategy:
    """A member, the one of the least hash."""
    return lambda keyed: keyed.groupBy("prototype").agg(F.min_by("features", F.struct(hashed_share("index", seed), "index")).alias("features"))


def arithmetic_mean() -> Strategy:
    return lambda keyed: keyed.groupBy("prototype").agg(Summarizer.mean(array_to_vector("features")).alias("mean")).select("prototype", vector_to_array("mean").alias("features"))


def median_candidate(group: int = 10, seed: int = 0, distance: Distance = DEFAULT) -> Strategy:
    """A member near the median, by :func:`approximate_median`; a signature's points are one task's work."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("index")["features"].to_list())
        return pd.DataFrame({"prototype": [key[0]], "features": [x[approximate_median(x, group, seed, distance)]]})

    return lambda keyed: keyed.groupBy("prototype").applyInPandas(run, "prototype long, features array<double>")


def sketch(points: DataFrame, params: Params, prototype: str | Strategy = "mean", seed: int = 0, group: int = 10) -> DataFrame:
    """prototype (id), features, members: points of one signature collapse to a random member, their mean, an approximate median, or what a strategy makes of them."""
    named = {"random": random_candidate(seed), "mean": arithmetic_mean(), "median": median_candidate(group, seed, params.distance)}
    if not callable(prototype) and prototype not in named:
        raise ValueError("prototype is random, mean, median or a function")
    keyed = points.select("index", "features", signature_id(params, dimension(points)).alias("prototype"))
    made = prototype(keyed) if callable(prototype) else named[prototype](keyed)
    return made.join(keyed.groupBy("prototype").agg(F.sort_array(F.collect_list("index")).alias("members")), "prototype")


def exact_median(x: np.ndarray, distance: Distance) -> int:
    """Row of the least sum of distances to all others, the first of equals."""
    return int(distance_matrix(x, distance).sum(1).argmin())


def approximate_median(x: np.ndarray, group: int = 10, seed: int = 0, distance: Distance = DEFAULT) -> int:
    """A tournament: medians of random groups of ``group`` go on until few are left."""
    rng = np.random.default_rng(seed)
    left = np.arange(len(x))
    while len(left) > max(2, min(group * group - 1, int(len(x) ** 0.5))):
        rng.shuffle(left)
        cuts = [left[i : i + group] for i in range(0, len(left), group)]
        left = np.array([c[exact_median(x[c], distance)] for c in cuts])
        if len(cuts) == 1:
            break
    left = np.sort(left)
    return int(left[exact_median(x[left], distance)])


def sketch_frequencies(sketched: DataFrame) -> DataFrame:
    """How many prototypes stand for how many points."""
    return sketched.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("prototypes"))


def lookup(sketched: DataFrame) -> DataFrame:
    """index to prototype."""
    return sketched.select(F.explode("members").alias("index"), "prototype")
