"""Points: a DataFrame of index (long), features (array of doubles) and any columns of meta data beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplicia.storage import cut_lineage


def points(df: DataFrame, index: str | Column, features: str | Column | list[str], *meta: str) -> DataFrame:
    """Name what identifies a row and its features; ``features`` is an array column or a list of numeric ones."""
    own = F.array(*(F.col(c).cast("double") for c in features)) if isinstance(features, list) else (F.col(features) if isinstance(features, str) else features).cast("array<double>")
    return df.select((F.col(index) if isinstance(index, str) else index).cast("long").alias("index"), own.alias("features"), *meta)


def read_csv(spark: SparkSession, path: str, header: bool = False, sep: str = ",") -> DataFrame:
    """Strings of a delimited file, trimmed; columns _c0.. without a header."""
    return spark.read.csv(path, header=header, sep=sep, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def with_index(df: DataFrame, *order: str, name: str = "index") -> DataFrame:
    """Dense numbers from 0 in the order of ``order``, or of the file without it.

    Numbers come from a count of each range of rows and a running number inside it; no task sees all rows."""
    parts = (df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    parts = cut_lineage(parts)  # counts and rows are of one evaluation, whatever is lost later
    sizes = parts.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first"))
    before = sizes.select("__part", "first", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("before") + F.col("__at") - F.col("first")).drop("__part", "__at", "first", "before")


def drop_rows(df: DataFrame, n: int, order: str) -> DataFrame:
    """All but the first n rows in an order."""
    return with_index(df, order, name="__row").where(F.col("__row") >= n).drop("__row")


def read_dense(spark: SparkSession, path: str, columns: int = 2) -> DataFrame:
    """Points of the first columns, sorted by them before they are numbered."""
    df = read_csv(spark, path).select(*(F.col(f"_c{i}").cast("double").alias(f"x{i}") for i in range(columns)))
    names = [f"x{i}" for i in range(columns)]
    return points(with_index(df, *names), "index", names)


def read_labelled(spark: SparkSession, path: str, features: int, header: bool = True, label_first: bool = False, sep: str = ",") -> DataFrame:
    """Points in file order with a category column, behind the features or before them."""
    df = read_csv(spark, path, header, sep)
    cols = df.columns
    values, label = (cols[1 : 1 + features], cols[0]) if label_first else (cols[:features], cols[features])
    numbered = with_index(df.select(*(F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(values)), F.col(f"`{label}`").alias("category")))
    return points(numbered, "index", [f"f{i}" for i in range(len(values))], "category")


def read_sparse(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Label, then numbers of which most are zero: index, category and a map of position to value."""
    df = read_csv(spark, path, header)
    label, *rest = df.columns
    pairs = F.filter(F.transform(F.array(*(F.col(f"`{c}`").cast("double") for c in rest)), lambda x, i: F.struct(i.alias("k"), x.alias("v"))), lambda e: e["v"] != 0)
    return with_index(df.select(F.col(f"`{label}`").alias("category"), F.map_from_entries(pairs).alias("values"))).select(F.col("index").cast("long"), "category", "values")


def densify(df: DataFrame, size: int, values: str = "values") -> DataFrame:
    """A map of position to value as an array of features."""
    return df.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col(values)[i], F.lit(0.0)))).drop(values)


def read_transposed(spark: SparkSession, path: str, meta_rows: int, sep: str = "\t", skip: int = 1, limit: int | None = None) -> DataFrame:
    """A matrix whose columns are points: ``meta_rows`` rows of meta data, ``skip`` rows to pass over, then one row a feature.

    index, meta (map of row name to text) and values (map of feature's number to value, zeros left out)."""
    rows = with_index(spark.read.text(path), name="row").select("row", F.transform(F.split("value", sep), lambda x: F.trim(x)).alias("cells"))
    cells = rows.select("row", F.col("cells")[0].alias("name"), F.posexplode("cells").alias("column", "cell")).where("column > 0")
    if limit is not None:
        cells = cells.where(F.col("column") <= limit)
    meta = cells.where(F.col("row") < meta_rows).groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "cell")))).alias("meta"))
    value = F.col("cell").cast("double")
    body = cells.where((F.col("row") >= meta_rows + skip) & value.isNotNull() & (value != 0)).withColumn("k", (F.col("row") - meta_rows - skip).cast("int"))
    values = body.groupBy("column").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", value.alias("v"))))).alias("values"))
    return meta.join(values, "column", "full").select((F.col("column") - 1).cast("long").alias("index"), "meta", F.coalesce("values", F.create_map().cast("map<int,double>")).alias("values"))


def random_graph(spark: SparkSession, n: int, kind: str = "loop", seed: int = 0) -> DataFrame:
    """Edges (src, dst) of a loop, a star, or random ones, for trials."""
    i = spark.range(n).select(F.col("id").alias("src"))
    dst = {"loop": (F.col("src") + 1) % n, "star": F.lit(0).cast("long"), "random": F.floor(F.rand(seed) * n)}[kind]
    return i.withColumn("dst", dst).where("src <> dst")
