"""The cover: overlapping bins of every lens, and the points in each of their products."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplicia.functions.filters import Lens
from simplicia.storage import cut_lineage


@dataclass(frozen=True)
class Filter:
    """A lens and how its range is covered. ``balanced`` cuts it where points are equally many."""

    lens: Lens
    bins: int = 20
    overlap: float = 0.25
    balanced: bool = False

    def __post_init__(self):
        if self.bins < 1 or not 0 <= self.overlap < 1:
            raise ValueError("bins must be positive and overlap in [0, 1)")

    def with_bins(self, bins: int) -> Filter:
        return replace(self, bins=bins)


def extra_bins(overlap: float) -> int:
    """Bins below its first that every point also falls in."""
    return math.ceil(round(1 / (1 - overlap), 9)) - 1


def bin_numbers(value: Column, low: Column, high: Column, bins: int, overlap: float) -> Column:
    """Numbers of the bins that hold a value; bin k begins at low + k * step. A lens of one value has bin 0 alone.

    The quotient is rounded before its floor, so that edges don't depend on the last digit."""
    step = (high - low) / (bins - (bins - 1) * overlap) * (1 - overlap)
    top = F.floor(F.round((value - low) / step, 9)).cast("int")
    return F.when(high == low, F.array(F.lit(0))).otherwise(F.sequence(top - extra_bins(overlap), top))


def lens_values(points: DataFrame, filters: tuple[Filter, ...], frames: dict | None = None, knn: dict[str, DataFrame] | None = None) -> DataFrame:
    """``points`` with f0, f1, ...: row-local lenses are columns, others join by index."""
    out = points
    for i, f in enumerate(filters):
        column = f.lens.column()
        if column is not None:
            out = out.withColumn(f"f{i}", column)
        else:
            frame = (frames or {}).get(f.lens)
            frame = f.lens.frame(points, (knn or {}).get(f.lens.graph())) if frame is None else frame
            out = out.join(frame.select("index", F.col("value").alias(f"f{i}")), "index")
    return out


def balanced_cuts(values: DataFrame, column: str, bins: int, name: str) -> DataFrame:
    """One row: the values at ranks ceil(k * n / bins) for k from 0 to ``bins``, exactly.

    Distinct values are counted and dealt by ranges; running counts inside a range and a sum of the ranges before it give
    every value's rank, so no task sees all of them."""
    counts = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n")).repartitionByRange("v").withColumn("part", F.spark_partition_id())
    counts = cut_lineage(counts)  # sums and rows are of one evaluation
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    ahead = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("part", ahead.alias("before"), F.sum("size").over(Window.partitionBy()).alias("total"))  # a row a range
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("part").orderBy("v"))
    ranked = counts.join(F.broadcast(before), "part").select("v", "total", upto.alias("upto"))
    at = [F.greatest(F.lit(1), F.ceil(F.lit(k) * F.col("total") / bins)) for k in range(bins + 1)]
    found = ranked.agg(*(F.min(F.when(F.col("upto") >= rank, F.col("v"))).alias(f"c{k}") for k, rank in enumerate(at)))
    return found.select(F.array(*(f"c{k}" for k in range(bins + 1))).alias(name))


def level_sets(points: DataFrame, filters: tuple[Filter, ...], frames: dict | None = None, knn: dict[str, DataFrame] | None = None) -> DataFrame:
    """``points`` once for each cell they are in: level_set (bin numbers) is added. Points without a lens value are in none.

    One aggregate gives all ranges, ranks the cuts of balanced ones; cells come from arithmetic, so no point meets another."""
    valued = lens_values(points, filters, frames, knn).dropna(subset=[f"f{i}" for i in range(len(filters))])
    bounds = []
    for i, f in enumerate(filters):
        bounds += [F.min(f"f{i}").alias(f"low{i}"), F.max(f"f{i}").alias(f"high{i}")]
    ranges = valued.agg(*bounds)  # one row
    for i, f in enumerate(filters):
        if f.balanced:
            ranges = ranges.crossJoin(F.broadcast(balanced_cuts(valued, f"f{i}", f.bins, f"cuts{i}")))
    out = valued.crossJoin(F.broadcast(ranges))
    for i, f in enumerate(filters):
        numbers = bin_numbers(F.col(f"f{i}"), F.col(f"low{i}"), F.col(f"high{i}"), f.bins, f.overlap)
        if f.balanced:
            # rank among the cuts, spread evenly, in place of the value
            value = F.col(f"f{i}")
            below = F.size(F.filter(f"cuts{i}", lambda c: c <= value)) - 1  # noqa: B023
            numbers = bin_numbers(below.cast("double"), F.lit(0.0), F.lit(float(f.bins)), f.bins, f.overlap)
        out = out.withColumn(f"b{i}", F.explode(numbers))
    cell = F.array(*(F.col(f"b{i}") for i in range(len(filters))))
    drop = [c for i, f in enumerate(filters) for c in (f"b{i}", f"low{i}", f"high{i}", *([f"cuts{i}"] if f.balanced else []))]
    return out.withColumn("level_set", cell).drop(*drop)
