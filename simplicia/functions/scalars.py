"""Small row-level functions and their relational forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dimension(points: DataFrame) -> int:
    """Features of a point, 0 for an empty table."""
    first = points.select(F.size("features")).first()
    return first[0] if first else 0


def hashed_share(column: Column | str, seed: int = 0) -> Column:
    """A number in [0, 1) from the MD5 of a seed and a value as text: the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col(column).cast("string") if isinstance(column, str) else column.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def prefix_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1: two arrays by their first difference; where one begins the other they are equal."""
    first = F.filter(F.zip_with(a, b, lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)), lambda s: s != 0)
    return F.coalesce(F.get(F.filter(first, lambda s: s.isNotNull()), F.lit(0)), F.lit(0))


def feature(n: int, features: str = "features") -> Column:
    return F.col(features)[n]


def to_bin(share: Column, bins: int) -> Column:
    """Bin of a share of 1: its floor, the last bin for 1 and more; NaN falls in bin 0."""
    return F.least(F.floor(F.nanvl(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")


def bin_length(total: float, bins: int, overlap: float) -> float:
    return total / (bins - (bins - 1) * overlap)


def gaussian_similarity(distance: Column, sigma: float = 1.0) -> Column:
    """exp(-d^2 / 2 sigma): sigma is not squared, as the embedding expects."""
    return F.exp(-distance * distance / (2 * sigma))


def without_position(array: Column, n: int) -> Column:
    return F.filter(array, lambda _, i: i != n)


def frequencies(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def sliding_pairs(df: DataFrame, column: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Consecutive values of a column, as ``left`` and ``right``."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("right", F.lead(column).over(w)).withColumn("last", F.lead(order).over(w).isNull()).where("not last").select(*by, F.col(column).alias("left"), "right")


def group_while(df: DataFrame, holds: Callable[[Column, Column], Column], column: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``run``: a new one begins where ``holds(before, value)`` is not true between neighbours."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(column).over(w)
    breaks = F.when(F.lag(order).over(w).isNull(), 0).otherwise(F.when(holds(before, F.col(column)), 0).otherwise(1))
    return df.withColumn("__break", breaks).withColumn("run", F.sum("__break").over(w)).drop("__break")


def group_repeats(df: DataFrame, column: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    return group_while(df, lambda a, b: a.eqNullSafe(b), column, order, by)


def merge_maps(a: Column, b: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Union of two maps; ``combine`` settles keys of both."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(combine(x, y)))


def average_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("average"))


def numbered(df: DataFrame, column: str, name: str = "number") -> DataFrame:
    """Dense numbers from 0 for the distinct values of a column, in their order."""
    keys = df.select(column).distinct()
    from simplicia.sources.readers import with_index

    return df.join(with_index(keys, column, name=name), column)
