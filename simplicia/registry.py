"""Every query of the engine, and the SQL that says the same."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.functions import distances as D
from simplicia.functions import filters as L
from simplicia.functions import scalars
from simplicia.functions.scale import BiggestGap, Danifold, FirstGap, Fixed, Histogram
from simplicia.operators import colour, inspect, knn, laplacian, lsh, mapper, pairs
from simplicia.operators.cover import Filter, level_sets
from simplicia.plans.pipeline import Params
from simplicia.plans.pipeline import mapper as run_mapper
from simplicia.plans.session import Session
from simplicia.sources import readers
from simplicia.storage import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.points(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.points(_read(spark, sf_dir, "customer"), "c_custkey", ["c_acctbal"], "c_mktsegment", "c_nationkey")


def _r(column, digits: int = 6):
    return F.round(column, digits)


# --- lens functions ---------------------------------------------------------------------------------------------------


def _lens(lens: L.Lens, digits: int = 6) -> Query:
    return lambda spark, d: lens.frame(vectors(spark, d)).select(F.col("index").alias("vec_id"), _r("value", digits).alias("value"))


_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) "


def _lens_sql(expression: str, digits: int = 6) -> str:
    return f"{_V}SELECT vec_id, round({expression}, {digits}) AS value FROM v"


def _pair_sql(aggregate: str, distance: str) -> str:
    return f"{_V}SELECT vec_id, round({aggregate}, 4) AS value FROM (SELECT a.vec_id, {distance} AS d FROM v a, v b WHERE a.vec_id <> b.vec_id), (SELECT count(*) AS n FROM v) GROUP BY vec_id, n"


# --- distances --------------------------------------------------------------------------------------------------------


def _distance(distance: D.Distance, threshold: float | None = None) -> Query:
    """Sum and maximum of each point's distances to points of larger id, by blocks; Jaccard on features above a threshold."""

    def run(spark, d):
        p = vectors(spark, d)
        if threshold is not None:
            p = p.withColumn("features", F.transform("features", lambda x: F.when(x > threshold, 1.0).otherwise(0.0)))
        return pairs.distances(p, distance).groupBy(F.col("src").alias("vec_id")).agg(_r(F.sum("distance"), 4).alias("total"), _r(F.max("distance"), 4).alias("largest"))

    return run


_ABS = "list_transform(list_zip(a.e, b.e), lambda z: abs(z[1] - z[2]))"
_DOT = "list_dot_product({0}.e, {1}.e)"


def _distance_sql(distance: str, vectors_sql: str = _V) -> str:
    return f"{vectors_sql}SELECT vec_id, round(sum(d), 4) AS total, round(max(d), 4) AS largest FROM (SELECT a.vec_id, {distance} AS d FROM v a, v b WHERE a.vec_id < b.vec_id) GROUP BY vec_id"


_SETS = "WITH v AS (SELECT vec_id, list_filter(range(len(embedding)), lambda i: embedding[i + 1] > 0.1) AS e FROM embeddings) "

# --- cover ------------------------------------------------------------------------------------------------------------


def _lines(spark, d):
    return readers.points(_read(spark, d, "lineitem"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), ["l_quantity", "l_extendedprice"])


def cover_1d(spark, d):
    return level_sets(_lines(spark, d), (Filter(L.Feature(0), 10, 0.5),)).select("index", F.col("level_set")[0].alias("bin"))


def cover_2d_counts(spark, d):
    cells = level_sets(_lines(spark, d), (Filter(L.Feature(0), 5, 0.25), Filter(L.Feature(1), 8, 0.5)))
    return cells.groupBy(F.col("level_set")[0].alias("bin0"), F.col("level_set")[1].alias("bin1")).agg(F.count("*").alias("n"))


def cover_bin_counts(spark, d):
    return level_sets(customers(spark, d), (Filter(L.Feature(0), 20, 0.6),)).groupBy(F.col("level_set")[0].alias("bin")).agg(F.count("*").alias("n"))


def cover_balanced(spark, d):
    return level_sets(customers(spark, d), (Filter(L.Feature(0), 10, 0.25, balanced=True),)).groupBy(F.col("level_set")[0].alias("bin")).agg(F.count("*").alias("n"))


def _cover_sql(value: str, bins: int, overlap: float, extra: int, suffix: str = "") -> str:
    step = f"((high{suffix} - low{suffix}) / ({bins} - ({bins} - 1) * {overlap}::DOUBLE) * (1 - {overlap}::DOUBLE))"
    top = f"CAST(floor(round(({value} - low{suffix}) / {step}, 9)) AS INT)"
    return f"CAST(unnest(generate_series({top} - {extra}, {top})) AS INT)"


# --- the pipeline on one feature ----------------------------------------------------------------------------------------

_PARAMS_1D = Params((Filter(L.Feature(0), 10, 0.5),), scale=Histogram(10))


def graph_1d(spark, d, collapse: bool = True, colouring: colour.Colouring = colour.nop):
    return run_mapper(customers(spark, d), _PARAMS_1D.with_collapse(collapse) if colouring is colour.nop else Params(_PARAMS_1D.filters, scale=_PARAMS_1D.scale, collapse=collapse, colouring=colouring))


def _nodes(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.col("level_set")[0].alias("bin"), F.col("size").cast("long").alias("size"), F.array_min("members").alias("least"), F.array_max("members").alias("greatest"))


_MAPPER = f"""
WITH ranged AS (SELECT c_custkey AS i, c_acctbal AS x, c_mktsegment, min(c_acctbal) OVER () AS low, max(c_acctbal) OVER () AS high FROM customer),
cells AS (SELECT i, x, {_cover_sql("x", 10, 0.5, 1)} AS bin FROM ranged),
gaps AS (SELECT i, x, bin, x - lag(x) OVER (PARTITION BY bin ORDER BY x, i) AS gap FROM cells),
heights AS (
  SELECT bin, gap AS h FROM gaps WHERE gap IS NOT NULL
  UNION ALL SELECT bin, max(x) - min(x) FROM cells GROUP BY bin HAVING count(*) > 1
),
ends AS (SELECT bin, min(h) AS lo, max(h) AS hi, (max(h) - min(h)) / 10 AS w FROM heights GROUP BY bin),
slots AS (SELECT DISTINCT bin, CAST(floor((h - lo) / w) AS INT) AS slot FROM heights JOIN ends USING (bin) WHERE w > 0),
free AS (SELECT bin, min(k) AS k FROM (SELECT bin, unnest(range(10)) AS k FROM ends) c WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.bin = c.bin AND s.slot = c.k) GROUP BY bin),
cutoffs AS (SELECT bin, hi, CASE WHEN w = 0 OR k IS NULL THEN hi ELSE lo + k * w END AS cutoff FROM ends LEFT JOIN free USING (bin)),
labelled AS (
  SELECT i, bin, sum(CASE WHEN gap >= cutoff THEN 1 ELSE 0 END) OVER (PARTITION BY bin ORDER BY x, i) AS label
  FROM gaps LEFT JOIN cutoffs USING (bin)
),
every AS (SELECT bin, label, list(i ORDER BY i) AS members FROM labelled GROUP BY bin, label),
clusters AS (
  SELECT md5(bin || ':' || array_to_string(members, ',')) AS cluster_id, bin, members, len(members) AS size
  FROM (SELECT members, min(bin) AS bin FROM every GROUP BY members)
),
loose AS (SELECT md5(bin || ':' || array_to_string(members, ',')) AS cluster_id, bin, members, len(members) AS size FROM every),
member AS (SELECT cluster_id, size, unnest(members) AS i FROM clusters),
edges AS (
  SELECT a.cluster_id AS src, b.cluster_id AS dst, count(*) AS shared FROM member a JOIN member b USING (i)
  WHERE a.size > b.size OR (a.size = b.size AND a.cluster_id < b.cluster_id) GROUP BY ALL
)
"""
_RECURSIVE = _MAPPER.replace("WITH ranged", "WITH RECURSIVE ranged", 1)


def _bin_sql(share: str, bins: int) -> str:
    return f"CAST(least(floor(coalesce({share}, 0) * {bins}), {bins - 1}) AS INT)"


def _coloured(colouring: colour.Colouring) -> Query:
    return lambda spark, d: graph_1d(spark, d, colouring=colouring).colours.select("cluster_id", F.coalesce(F.col("bin").cast("int"), F.lit(-1)).alias("bin"))


def components_1d(spark, d):
    g = graph_1d(spark, d)
    return inspect.components(g.clusters, g.edges)


def graph_export(spark, d):
    g = graph_1d(spark, d)
    degree = g.edges.select(F.explode(F.array("src", "dst")).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("degree"))
    return g.clusters.join(degree, "cluster_id", "left").select("cluster_id", F.col("size").cast("long").alias("size"), F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def mapper_fixed_1d(spark, d):
    g = run_mapper(customers(spark, d), Params((Filter(L.Feature(0), 10, 0.5),), scale=Fixed(20.0)))
    return _nodes(g.clusters)


def mapper_linkages(spark, d):
    """Memberships under every linkage: each puts every point of a cell into one cluster of it."""
    from simplicia.functions.linkage import METHODS

    cells = level_sets(vectors(spark, d), (Filter(L.Feature(0), 20, 0.25),)).persist()
    out = None
    for method in METHODS:
        found = mapper.form_clusters(mapper.local_clusters(cells, D.EUCLIDEAN, method, Histogram(10)), collapse=False)
        one = found.groupBy(F.col("level_set")[0].alias("bin")).agg(F.sum("size").cast("long").alias("memberships")).select(F.lit(method).alias("method"), "bin", "memberships")
        out = one if out is None else out.unionByName(one)
    return out


# --- heights and scale selection ----------------------------------------------------------------------------------------


def _cut_by_segment(selector) -> Query:
    """The height at which the balances of every market segment and nation would be cut."""

    def run(spark, d):
        cells = customers(spark, d).withColumn("level_set", F.array(F.col("c_nationkey").cast("int")))
        trees = mapper.dendrograms(cells)

        def select(batches):
            import numpy as np
            import pandas as pd

            for pdf in batches:
                cuts = [selector(np.append(h, x) if len(h) else np.asarray(h)) for h, x in zip(pdf["heights"], pdf["diameter"], strict=True)]
                yield pd.DataFrame({"nation": [int(c[0]) for c in pdf["level_set"]], "cutoff": np.asarray(cuts, float)})

        return trees.mapInPandas(select, "nation int, cutoff double").select("nation", _r("cutoff", 4).alias("cutoff"))

    return run


_HEIGHTS = """
WITH gaps AS (SELECT c_nationkey AS nation, c_acctbal - lag(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS h FROM customer),
heights AS (
  SELECT nation, h FROM gaps WHERE h IS NOT NULL
  UNION ALL SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) FROM customer GROUP BY c_nationkey HAVING count(*) > 1
),
ends AS (SELECT nation, min(h) AS lo, max(h) AS hi FROM heights GROUP BY nation),
ordered AS (SELECT nation, h, lead(h) OVER (PARTITION BY nation ORDER BY h) AS next, row_number() OVER (PARTITION BY nation ORDER BY h) AS k FROM heights)
"""


def _free_slot_sql(base: str, width: str, edge: int) -> str:
    return (
        f"{_HEIGHTS}, slots AS (SELECT DISTINCT nation, CAST(floor((h - {base}) / {width}) AS INT) AS slot FROM heights JOIN ends USING (nation) WHERE {width} > 0), "
        "free AS (SELECT nation, min(k) AS k FROM (SELECT nation, unnest(range(10)) AS k FROM ends) c WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE s.nation = c.nation AND s.slot = c.k) GROUP BY nation) "
        f"SELECT nation, round(CASE WHEN k IS NULL OR {width} = 0 THEN hi ELSE {base} + (k + {edge}) * {width} END, 4) AS cutoff FROM ends LEFT JOIN free USING (nation)"
    )


def heights_1d(spark, d):
    cells = customers(spark, d).withColumn("level_set", F.array(F.col("c_nationkey").cast("int")))
    h = mapper.dendrograms(cells).select(F.col("level_set")[0].alias("nation"), F.explode("heights").alias("h"))
    return h.groupBy("nation").agg(F.count("*").alias("n"), _r(F.sum("h"), 4).alias("total"), _r(F.max("h"), 4).alias("largest"))


# --- neighbour graphs ---------------------------------------------------------------------------------------------------

_K = 5


def _graph(spark, d):
    return knn.exact_knn(vectors(spark, d), _K, D.EUCLIDEAN)


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", _r("distance").alias("distance"))


_KNN = _V + f"""
, every AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.e, b.e) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id),
knn AS (SELECT src, dst, distance FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY distance, dst DESC) AS place FROM every) WHERE place <= {_K})
"""
_BOTH = _KNN + ", both_ends AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n, min(distance) AS d FROM knn GROUP BY ALL) "


def _symmetric(**how) -> Query:
    return lambda spark, d: _edges(knn.symmetricize(_graph(spark, d), **how))


def _symmetric_sql(weight: str, where: str = "true") -> str:
    return f"{_BOTH}SELECT a AS src, b AS dst, round({weight}, 6) AS distance FROM both_ends WHERE {where} UNION ALL SELECT b, a, round({weight}, 6) FROM both_ends WHERE {where}"


def _affinity(spark, d):
    return laplacian.affinities(knn.symmetricize(_graph(spark, d)), 1.0)


_AFFINITY = _BOTH + """
, affinity AS (SELECT a AS i, b AS j, exp(-d * d / 2) AS value FROM both_ends UNION ALL SELECT b, a, exp(-d * d / 2) FROM both_ends),
degree AS (SELECT i, sum(value) AS degree FROM affinity GROUP BY i)
"""


def knn_accuracy(spark, d):
    p = vectors(spark, d)
    return knn.relative_accuracy(knn.sampled_knn(p, _K, D.MANHATTAN, amount=100), knn.exact_knn(p, _K, D.EUCLIDEAN)).select(_r("accuracy").alias("accuracy"))


#: Blocks of a fifth of all points: without clusters, recall depends on the share of the points that one meets.
_FAST = {"tables": 10, "share": 0.2, "params": lsh.Params(10, 1.0, D.EUCLIDEAN, seed=7)}


def fast_accuracy(spark, d) -> DataFrame:
    """One row, ``accuracy``: recall of the approximate graph against the exact one."""
    p = vectors(spark, d)
    return knn.relative_accuracy(knn.fast_knn(p, 10, D.EUCLIDEAN, **_FAST), knn.exact_knn(p, 10, D.EUCLIDEAN))


def fast_knn_accuracy(spark, d):
    """Whether recall is 0.9 or more."""
    return fast_accuracy(spark, d).select((F.col("accuracy") >= 0.9).cast("int").alias("accurate"))


def fast_knn(spark, d):
    """Of the approximate graph: neighbours of each point, whether their ranks are dense and their distances true."""
    p = vectors(spark, d)
    found = knn.fast_knn(p, 10, D.EUCLIDEAN, **_FAST)
    a, b = (p.select(F.col("index").alias(end), F.col("features").alias(x)) for end, x in (("src", "x"), ("dst", "y")))
    off = F.abs(D.EUCLIDEAN.column(F.col("x"), F.col("y")) - F.col("distance"))
    return found.join(a, "src").join(b, "dst").groupBy(F.col("src").alias("vec_id")).agg(F.count("*").alias("neighbours"), F.countDistinct("rank").alias("ranks"), (F.max(off) < 1e-9).cast("int").alias("true_distances"))


def _sketched(kind: str) -> Query:
    def run(spark, d):
        s = lsh.sketch(vectors(spark, d), _LSH, kind)
        return s.select("prototype", F.size("members").cast("long").alias("size"), _r(F.col("features")[0], 4).alias("x0"))

    return run


def session_steps(spark, d):
    """A session's answers to four parameter sets, of which two differ only in what comes after clustering."""
    s = Session(customers(spark, d))
    sets = [_PARAMS_1D, _PARAMS_1D.with_collapse(False), _PARAMS_1D.with_collapse(False), _PARAMS_1D.with_resolution(20), _PARAMS_1D.with_bins(0, 5)]
    out = None
    for step, g in enumerate(s.run(sets)):
        one = g.clusters.agg(F.count("*").alias("clusters"), F.sum("size").cast("long").alias("memberships")).select(F.lit(step).alias("step"), "clusters", "memberships")
        out = one if out is None else out.unionByName(one)
    return out


# --- readers: tables written as text files in the shared folder and read back ------------------------------------------


def _as_text(lines: DataFrame, name: str) -> str:
    """Path of a folder of text files with one ``line`` a row, in the order of the rows' partitions."""
    path = f"{shared_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.select("line").write.text(path)
    return path


def _numbers(columns: list, sep: str = ",") -> Column:
    return F.concat_ws(sep, *columns)


def read_csv(spark, d):
    """Names with blanks around them, trimmed."""
    nation = _read(spark, d, "nation")
    path = _as_text(nation.select(F.format_string(" %d ,  %s,%d", "n_nationkey", "n_name", "n_regionkey").alias("line")), "csv")
    return readers.read_csv(spark, path).select(F.col("_c0").cast("int").alias("key"), F.col("_c1").alias("name"), F.col("_c2").cast("int").alias("region"))


def read_numbered(spark, d):
    return readers.with_index(_read(spark, d, "orders").select("o_orderkey"), "o_orderkey").select(F.col("index").cast("long").alias("index"), "o_orderkey")


def read_dropped(spark, d):
    return readers.drop_rows(_read(spark, d, "customer").select("c_custkey"), 100, "c_custkey")


def read_dense(spark, d):
    """Points sorted by their features before they are numbered."""
    c = _read(spark, d, "customer").where("c_acctbal is not null")
    path = _as_text(c.select(_numbers([F.format_string("%.2f", F.col("c_acctbal").cast("double")), F.col("c_custkey").cast("string")]).alias("line")), "dense")
    p = readers.read_dense(spark, path)
    return p.select(F.col("index").cast("long").alias("index"), F.col("features")[0].alias("x"), F.col("features")[1].alias("y"))


def _labelled(spark, d, label_first: bool):
    c = _read(spark, d, "customer").where("c_acctbal is not null").coalesce(1).sortWithinPartitions("c_custkey")
    values = [F.col("c_custkey").cast("string"), F.format_string("%.2f", F.col("c_acctbal").cast("double"))]
    label = F.trim("c_mktsegment")
    path = _as_text(c.select(_numbers([label, *values] if label_first else [*values, label]).alias("line")), "labelled")
    p = readers.read_labelled(spark, path, 2, header=False, label_first=label_first)
    return p.select(F.col("index").cast("long").alias("index"), F.col("features")[0].cast("long").alias("key"), F.col("features")[1].alias("balance"), "category")


def read_sparse(spark, d):
    """Embeddings without their small entries as label and numbers, read as maps and made dense again."""
    v = _read(spark, d, "embeddings").coalesce(1).sortWithinPartitions("vec_id")
    cells = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) > 0.1, F.round(x, 4)).otherwise(0.0).cast("string"))
    path = _as_text(v.select(F.concat_ws(",", F.col("label").cast("string"), F.array_join(cells, ",")).alias("line")), "sparse")
    s = readers.read_sparse(spark, path)
    n = scalars.dimension(v.select(F.col("embedding").alias("features")))
    dense = readers.densify(s.withColumn("entries", F.size("values")), n)
    return dense.select("index", "category", F.col("entries").cast("long").alias("entries"), _r(F.aggregate("features", F.lit(0.0), lambda t, x: t + x), 4).alias("total"), F.col("features")[0].alias("x0"))


def read_transposed(spark, d):
    """Nations as columns and market segments as rows, below two rows of meta data and one to pass over; zeros are left out."""
    nation, customer = _read(spark, d, "nation"), _read(spark, d, "customer")
    counts = nation.crossJoin(F.broadcast(customer.select("c_mktsegment").distinct())).join(customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").count(), ["n_nationkey", "c_mktsegment"], "left")
    joined = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", x.alias("x")))), lambda s: s["x"]), "\t")
    body = counts.groupBy("c_mktsegment").agg(joined(F.coalesce("count", F.lit(0)).cast("string")).alias("cells"))
    lines = body.select(F.lit(3).alias("at"), F.trim("c_mktsegment").alias("name"), "cells")
    for at, name, cell in ((0, "nation", F.trim("n_name")), (1, "region", F.col("n_regionkey").cast("string")), (2, "pass", F.lit("-"))):
        lines = lines.unionByName(nation.groupBy().agg(joined(cell).alias("cells")).select(F.lit(at).alias("at"), F.lit(name).alias("name"), "cells"))
    path = _as_text(lines.coalesce(1).sortWithinPartitions("at", "name").select(F.concat_ws("\t", "name", "cells").alias("line")), "transposed")
    found = readers.read_transposed(spark, path, 2)
    return found.select("index", F.col("meta")["nation"].alias("nation"), F.col("meta")["region"].cast("int").alias("region"), F.explode("values").alias("segment", "n")).select("index", "nation", "region", "segment", F.col("n").cast("long").alias("n"))


# --- sinks and scalars ----------------------------------------------------------------------------------------------------


def dot_lines(spark, d):
    g = graph_1d(spark, d)
    return inspect.dot_lines(g.clusters, g.edges)


def graph_nodes(spark, d):
    return inspect.graph_nodes(graph_1d(spark, d).clusters)


def graph_links(spark, d):
    return inspect.graph_links(graph_1d(spark, d).edges)


def numbered_clusters(spark, d):
    return inspect.numbered_clusters(graph_1d(spark, d).clusters).select("cluster_id", F.col("number").cast("long").alias("number"))


def cluster_points(spark, d):
    return inspect.cluster_points(graph_1d(spark, d).clusters).select("cluster_id", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


def synthetic_graphs(spark, d):
    """A loop and a star over as many nodes as there are nations."""
    n = _read(spark, d, "nation").count()
    return readers.random_graph(spark, n, "loop").withColumn("kind", F.lit("loop")).unionByName(readers.random_graph(spark, n, "star").withColumn("kind", F.lit("star"))).select("kind", "src", "dst")


def custom_lens(spark, d):
    """Customers of each cell of a lens that is any DataFrame, here the sums of their orders."""
    sums = _read(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("index")).agg(F.count("*").alias("value"))
    cells = level_sets(customers(spark, d), (Filter(L.Custom("orders", sums), 6, 0.5),))
    return cells.groupBy(F.col("level_set")[0].alias("bin")).agg(F.count("*").alias("n"))


def frequencies(spark, d):
    return scalars.frequencies(_read(spark, d, "events"), "event_type")


def sliding_pairs(spark, d):
    e = _read(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return scalars.sliding_pairs(e, "event_type", "at", ("user_id",)).groupBy("user_id", "left", "right").agg(F.count("*").alias("n"))


def merged_maps(spark, d):
    """Customers by segment of even and of odd keys, in one map for each nation, summed where both have the segment."""
    counts = _read(spark, d, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 2).alias("odd"), "c_mktsegment").count()
    maps = counts.groupBy("c_nationkey", "odd").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "count"))).alias("m"))
    even, odd = (maps.where(f"odd = {k}").select("c_nationkey", F.col("m").alias(f"m{k}")) for k in (0, 1))
    empty = F.create_map().cast("map<string,bigint>")
    both = even.join(odd, "c_nationkey", "full").select("c_nationkey", scalars.merge_maps(F.coalesce("m0", empty), F.coalesce("m1", empty), lambda x, y: x + y).alias("m"))
    return both.select("c_nationkey", F.explode("m").alias("segment", "n"))


def average_by_key(spark, d):
    return scalars.average_by_key(customers(spark, d), "c_mktsegment", "c_nationkey").select("c_mktsegment", _r("average").alias("average"))


def map_to_int(spark, d):
    return scalars.numbered(_read(spark, d, "customer").select("c_mktsegment"), "c_mktsegment").groupBy("c_mktsegment", F.col("number").cast("long").alias("number")).agg(F.count("*").alias("n"))


def without_position(spark, d):
    kept = vectors(spark, d).select("index", scalars.without_position(F.col("features"), 1).alias("f"))
    return kept.select(F.col("index").alias("vec_id"), F.size("f").cast("long").alias("n"), _r(F.aggregate("f", F.lit(0.0), lambda s, x: s + x)).alias("total"))


def prefix_order(spark, d):
    """Pairs of nations' letters: the order by the first difference, equal where one begins the other."""
    n = _read(spark, d, "nation").select("n_nationkey", F.split(F.substring("n_name", 1, 4), "").alias("c"))
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("c").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.slice("c", 1, 2).alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", scalars.prefix_order(F.col("x"), F.col("y")).alias("sign"))


def pair_columns(spark, d):
    """All pairs of suppliers of one nation's size of table: distances in Catalyst, without blocks."""
    nation = readers.points(_read(spark, d, "nation"), "n_nationkey", ["n_nationkey", "n_regionkey"])
    return pairs.pair_column(nation, D.MANHATTAN.column).select("src", "dst", _r("distance").alias("distance"))


def distance_matrix(spark, d):
    """The local matrix of the points of a cell, here of each region's nations."""
    import numpy as np
    import pandas as pd

    def run(pdf):
        pdf = pdf.sort_values("n_nationkey")
        ids, m = pdf["n_nationkey"].to_numpy(), D.distance_matrix(np.stack([ids_ for ids_ in pdf[["n_nationkey", "n_regionkey"]].to_numpy(float)]), D.EUCLIDEAN)
        i, j = np.nonzero(np.tri(len(ids), k=-1))
        return pd.DataFrame({"region": int(pdf["n_regionkey"].iloc[0]), "a": ids[i], "b": ids[j], "distance": m[i, j].round(6)})

    return _read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_regionkey").cast("int").alias("n_regionkey")).groupBy("n_regionkey").applyInPandas(run, "region int, a long, b long, distance double")


def palettes(spark, d):
    """The first colours of every qualitative scheme by size."""
    rows = [(name, n, k, c) for name in colour.QUALITATIVE for n in range(3, len(colour.QUALITATIVE[name].split()) + 1) for k, c in enumerate(colour.palette(name, n))]
    return spark.createDataFrame(rows, "scheme string, n int, k int, colour string")


# --- invariants of what SQL can't compute --------------------------------------------------------------------------------


def pca_lens(spark, d):
    """All components only turn the points: squared distances between neighbours in vec_id stay."""
    p = vectors(spark, d)
    turned = L.PrincipalComponent(0, k=scalars.dimension(p)).all(p).withColumn("next", F.col("index") + 1)
    a, b = turned.select("next", F.col("values").alias("x")), turned.select("index", F.col("values").alias("y"))
    squares = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, F.col("next") == F.col("index")).select(F.col("index").alias("vec_id"), F.round(squares, 4).alias("square"))


def pca_variances(spark, d):
    """Components have no covariance, and their variances fall."""
    p = L.PrincipalComponent(0, k=5).all(vectors(spark, d))
    names = [F.covar_samp(F.col("values")[i], F.col("values")[j]).alias(f"c{i}{j}") for i in range(5) for j in range(i, 5)]
    one = p.agg(*names)
    zero = [F.abs(F.col(f"c{i}{j}")) < 1e-8 for i in range(5) for j in range(i + 1, 5)]
    falls = [F.col(f"c{i}{i}") >= F.col(f"c{i + 1}{i + 1}") - 1e-12 for i in range(4)]
    return one.select(F.array_min(F.array(*(c.cast("int") for c in zero))).alias("uncorrelated"), F.array_min(F.array(*(c.cast("int") for c in falls))).alias("falling"))


def _first_vector(vectors: DataFrame) -> DataFrame:
    """The leading singular vector of a normalised matrix: the roots of the degrees' shares."""
    return vectors.select("index", F.round(F.col("values")[0], 5).alias("value"))


def _lengths(rows: DataFrame) -> DataFrame:
    """Rows of an embedding have length one."""
    return rows.select("index", F.size("values").cast("long").alias("columns"), F.round(F.sqrt(F.aggregate("values", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("length"))


def laplacian_embedding(spark, d):
    return _lengths(laplacian.embedding(_affinity(spark, d), 5))


def tanimoto_embedding(spark, d):
    return _lengths(laplacian.tanimoto_embedding(vectors(spark, d), 3))


def mapper_laplacian(spark, d):
    """The pipeline under a lens that reads a neighbour graph: points that each cell's clusters hold in all, against one lens alone."""
    p = vectors(spark, d)
    graph = knn.symmetricize(knn.exact_knn(p, _K, D.EUCLIDEAN))
    g = run_mapper(p, Params((Filter(L.LaplacianEigenVector(0, distance=D.EUCLIDEAN), 5, 0.5),), D.EUCLIDEAN, scale=FirstGap(10), collapse=False), knn={"euclidean": graph})
    return mapper.memberships(g.clusters).groupBy(F.col("index").alias("vec_id")).agg(F.countDistinct("cluster_id").alias("clusters"))


_LSH = lsh.Params(2, 1.0, D.EUCLIDEAN, seed=3)


def _places_sql(params: lsh.Params, size: int = 64) -> str:
    """A signature's whole numbers in SQL, from the same drawn projections."""
    import numpy as np

    rng, name = np.random.default_rng(params.seed), params.distance.name
    places = []
    for _ in range(params.length):
        w = rng.standard_cauchy(size) if name == "manhattan" else rng.standard_normal(size)
        shift = float(rng.uniform(0, params.radius))
        inner = f"list_dot_product(e, {w.tolist()!r}::DOUBLE[])"
        places.append(f"CAST({inner} >= 0 AS BIGINT)" if name == "cosine" else f"CAST(floor(({inner} + {shift!r}) / {params.radius!r}) AS BIGINT)")
    return f"concat_ws(',', {', '.join(places)})"


def _signature_sql() -> str:
    return f"{_V}, s AS (SELECT vec_id, e, CAST('0x' || substr(md5({_places_sql(_LSH)}), 1, 15) AS BIGINT) AS prototype FROM v) "


_SIGNED = {d.name: lsh.Params(6, 2.0, d, seed=4) for d in (D.EUCLIDEAN, D.COSINE, D.MANHATTAN)}


def _signatures(name: str) -> tuple[Query, str]:
    params = _SIGNED[name]

    def run(spark, d):
        p = vectors(spark, d)
        text = F.array_join(F.transform(lsh.signature(params, scalars.dimension(p)), lambda x: x.cast("long").cast("string")), ",")
        return p.select(F.col("index").alias("vec_id"), text.alias("signature"))

    return run, f"{_V}SELECT vec_id, {_places_sql(params)} AS signature FROM v"


def sketched_lens(spark, d):
    """A lens over all pairs on prototypes only, and its value at every point."""
    lens = L.Sketched(L.Eccentricity(1, D.EUCLIDEAN), _LSH, "mean")
    return lens.frame(vectors(spark, d)).select(F.col("index").alias("vec_id"), F.round("value", 4).alias("value"))


def sketch_sizes(spark, d):
    return lsh.sketch_frequencies(lsh.sketch(vectors(spark, d), _LSH, "mean")).select(F.col("size").cast("long").alias("size"), "prototypes")


def sketch_lookup(spark, d):
    return lsh.lookup(lsh.sketch(vectors(spark, d), _LSH, "mean")).select(F.col("index").alias("vec_id"), "prototype")


def sketch_median(spark, d):
    """Medians are members: whose prototype each one is, and that its distances' sum is not above the mean of all members' sums."""
    p = vectors(spark, d)
    s = lsh.sketch(p, _LSH, "median")
    mine = lsh.lookup(s).join(p.select("index", F.col("features").alias("f")), "index").join(s.select("prototype", F.col("features").alias("m")), "prototype")
    return mine.groupBy("prototype").agg(F.count("*").alias("size"), F.max((F.col("f") == F.col("m")).cast("int")).alias("member"))


def fast_knn_jobs(spark, d):
    """Whether tables in three jobs give the graph that they give at once."""
    p = vectors(spark, d)
    edges = [knn.fast_graph(p, knn.FastParams(k=5, distance=D.EUCLIDEAN, tables=3, jobs=j, share=0.2, lsh=_FAST["params"])).select("src", "dst") for j in (1, 3)]
    apart = edges[0].exceptAll(edges[1]).unionByName(edges[1].exceptAll(edges[0]))
    return apart.agg((F.count("*") == 0).cast("int").alias("same"))


def knn_fraction(spark, d):
    return _edges(knn.sampled_knn(vectors(spark, d), _K, D.EUCLIDEAN, fraction=0.2, seed=5))


def mapper_nd(spark, d):
    """Embeddings under two lenses, cut at a fixed height: clusters are components of near pairs in every cell."""
    g = run_mapper(vectors(spark, d), Params((Filter(L.Feature(0), 4, 0.5), Filter(L.FeatureMean(), 3, 0.25)), D.EUCLIDEAN, scale=Fixed(1.25), collapse=False))
    return g.clusters.select(F.col("level_set")[0].alias("bin0"), F.col("level_set")[1].alias("bin1"), F.array_min("members").alias("least"), F.col("size").cast("long").alias("size"))


# --- small relational forms ---------------------------------------------------------------------------------------------


def event_runs(spark, d):
    """Runs of equal event types of each user, in time."""
    runs = scalars.group_repeats(_read(spark, d, "events").withColumn("at", F.struct("ts", "event_id")), "event_type", "at", ("user_id",))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n")).select("user_id", F.col("run").cast("long").alias("run"), "event_type", "n")


def category_frequencies(spark, d):
    return inspect.category_frequencies(customers(spark, d), graph_1d(spark, d).clusters, "c_mktsegment")


_LABELLED = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS index, CAST(c_custkey AS BIGINT) AS key, CAST(c_acctbal AS DOUBLE) AS balance, trim(c_mktsegment) AS category FROM customer WHERE c_acctbal IS NOT NULL"
_NUMBERED = _MAPPER + ", numbered AS (SELECT cluster_id, bin, size, row_number() OVER (ORDER BY bin, members, cluster_id) - 1 AS number FROM clusters) "
#: Ten cuts where customers are equally many; a value's place among them is covered as a lens would be.
_BALANCED = (
    "WITH o AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS r, count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL), "
    "k AS (SELECT unnest(range(11)) AS k), cuts AS (SELECT k, min(x) AS c FROM o, k WHERE r >= greatest(1, ceil(k * n / 10.0)) GROUP BY k), "
    "placed AS (SELECT r, count(*) - 1 AS below FROM o JOIN cuts ON c <= x GROUP BY r, x) "
    f"SELECT bin, count(*) AS n FROM (SELECT {_cover_sql('below', 10, 0.25, 1)} AS bin FROM placed, (SELECT 0.0::DOUBLE AS low, 10.0::DOUBLE AS high)) GROUP BY bin"
)


def _session_sql() -> str:
    """Clusters and memberships of the session's four parameter sets, each a run of its own."""
    five = _MAPPER.replace(_cover_sql("x", 10, 0.5, 1), _cover_sql("x", 5, 0.5, 1))
    twenty = _MAPPER.replace("/ 10 AS w", "/ 20 AS w").replace("unnest(range(10)) AS k", "unnest(range(20)) AS k")
    steps = [(_MAPPER, "clusters"), (_MAPPER, "every"), (twenty, "clusters"), (five, "clusters")]
    return " UNION ALL ".join(f"SELECT * FROM ({sql}SELECT CAST({k} AS INT) AS step, count(*) AS clusters, CAST(sum(len(members)) AS BIGINT) AS memberships FROM {of})" for k, (sql, of) in enumerate(steps))


_SESSION = _session_sql()
_MACHINERY = "c_mktsegment = 'MACHINERY'"


def _registered() -> dict[str, tuple[Query, str | None]]:
    euclid, manhattan = "list_distance(a.e, b.e)", f"list_sum({_ABS})"
    dots = f"({_DOT.format('a', 'b')})", f"({_DOT.format('a', 'a')})", f"({_DOT.format('b', 'b')})"
    shared = "len(list_intersect(a.e, b.e))"
    node_columns = "cluster_id, bin, CAST(size AS BIGINT) AS size, list_min(members) AS least, list_max(members) AS greatest"
    return {
        "filter_feature": (_lens(L.Feature(0)), _lens_sql("e[1]")),
        "filter_meta": (_lens(L.Meta("label")), _lens_sql("CAST(label AS DOUBLE)")),
        "filter_min": (_lens(L.FeatureMin()), _lens_sql("list_min(e)")),
        "filter_max": (_lens(L.FeatureMax()), _lens_sql("list_max(e)")),
        "filter_mean": (_lens(L.FeatureMean()), _lens_sql("list_avg(e)")),
        "filter_variance": (_lens(L.FeatureVariance()), _lens_sql("list_var_samp(e)")),
        "filter_stdev": (_lens(L.FeatureStDev()), _lens_sql("list_stddev_samp(e)")),
        "filter_ecc_inf": (_lens(L.Eccentricity(math.inf, D.EUCLIDEAN), 4), _pair_sql("max(d)", euclid)),
        "filter_ecc_1": (_lens(L.Eccentricity(1), 4), _pair_sql("sum(d) / n", manhattan)),
        "filter_ecc_2": (_lens(L.Eccentricity(2, D.EUCLIDEAN), 4), _pair_sql("sqrt(sum(d * d)) / n", euclid)),
        "filter_density": (_lens(L.Density(1.0, D.EUCLIDEAN), 4), _pair_sql("sum(exp(-d * d / 2))", euclid)),
        "dist_euclidean": (_distance(D.EUCLIDEAN), _distance_sql(euclid)),
        "dist_manhattan": (_distance(D.MANHATTAN), _distance_sql(manhattan)),
        "dist_chebyshev": (_distance(D.CHEBYSHEV), _distance_sql(f"list_max({_ABS})")),
        "dist_cosine": (_distance(D.COSINE), _distance_sql(f"1 - {dots[0]} / (sqrt({dots[1]}) * sqrt({dots[2]}))")),
        "dist_minkowski": (_distance(D.minkowski(3)), _distance_sql("pow(list_sum(list_transform(list_zip(a.e, b.e), lambda z: pow(abs(z[1] - z[2]), 3))), 1.0 / 3)")),
        "dist_lp": (_distance(D.lp_norm(0.5)), _distance_sql("pow(list_sum(list_transform(list_zip(a.e, b.e), lambda z: sqrt(abs(z[1] - z[2])))), 2)")),
        "dist_tanimoto": (_distance(D.TANIMOTO), _distance_sql(f"1 - {dots[0]} / ({dots[1]} + {dots[2]} - {dots[0]})")),
        "dist_jaccard": (_distance(D.JACCARD, 0.1), _distance_sql(f"1 - CASE WHEN len(a.e) + len(b.e) = 0 THEN 1 ELSE {shared} / (len(a.e) + len(b.e) - {shared}) END", _SETS)),
        "cover_1d": (cover_1d, f"SELECT l_orderkey * 10 + l_linenumber AS index, {_cover_sql('l_quantity', 10, 0.5, 1)} AS bin FROM lineitem, (SELECT min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem)"),
        "cover_2d_counts": (cover_2d_counts, f"SELECT bin0, bin1, count(*) AS n FROM (SELECT bin0, {_cover_sql('x1', 8, 0.5, 1, '1')} AS bin1 FROM (SELECT l_extendedprice AS x1, low1, high1, {_cover_sql('l_quantity', 5, 0.25, 1, '0')} AS bin0 FROM lineitem, (SELECT min(l_quantity) AS low0, max(l_quantity) AS high0, min(l_extendedprice) AS low1, max(l_extendedprice) AS high1 FROM lineitem))) GROUP BY ALL"),
        "cover_bin_counts": (cover_bin_counts, f"SELECT bin, count(*) AS n FROM (SELECT {_cover_sql('c_acctbal', 20, 0.6, 2)} AS bin FROM customer, (SELECT min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer)) GROUP BY bin"),
        "cover_balanced": (cover_balanced, _BALANCED),
        "heights_1d": (heights_1d, f"{_HEIGHTS}SELECT nation, count(*) AS n, round(sum(h), 4) AS total, round(max(h), 4) AS largest FROM gaps WHERE h IS NOT NULL GROUP BY nation"),
        "scale_histogram": (_cut_by_segment(Histogram(10)), _free_slot_sql("lo", "((hi - lo) / 10)", 0)),
        "scale_danifold": (_cut_by_segment(Danifold(10)), _free_slot_sql("0", "(hi / 10)", 1)),
        "scale_first_gap": (_cut_by_segment(FirstGap(10)), f"{_HEIGHTS}SELECT nation, round(coalesce(min_by((h + next) / 2, k) FILTER (next - h > 0.1 * hi), max(hi)), 4) AS cutoff FROM ordered JOIN ends USING (nation) GROUP BY nation"),
        "scale_biggest_gap": (_cut_by_segment(BiggestGap()), f"{_HEIGHTS}SELECT nation, round(coalesce(max_by((h + next) / 2, next - h) FILTER (next IS NOT NULL), max(h)), 4) AS cutoff FROM ordered GROUP BY nation"),
        "mapper_nodes_1d": (lambda s, d: _nodes(graph_1d(s, d, collapse=False).clusters), f"{_MAPPER}SELECT {node_columns} FROM loose"),
        "mapper_collapsed_1d": (lambda s, d: _nodes(graph_1d(s, d).clusters), f"{_MAPPER}SELECT {node_columns} FROM clusters"),
        "mapper_edges_1d": (lambda s, d: graph_1d(s, d).edges, f"{_MAPPER}SELECT src, dst, shared FROM edges"),
        "mapper_fixed_1d": (mapper_fixed_1d, _MAPPER.replace("CASE WHEN w = 0 OR k IS NULL THEN hi ELSE lo + k * w END AS cutoff", "20.0 AS cutoff").replace("gap >= cutoff", "gap >= cutoff AND hi_gap >= cutoff").replace("FROM gaps LEFT JOIN cutoffs USING (bin)", "FROM (SELECT *, max(gap) OVER (PARTITION BY bin) AS hi_gap FROM gaps) LEFT JOIN cutoffs USING (bin)") + f"SELECT {node_columns} FROM clusters"),
        "mapper_linkages": (mapper_linkages, f"SELECT method, bin, memberships FROM (SELECT bin, count(*) AS memberships FROM (SELECT {_cover_sql('x', 20, 0.25, 1)} AS bin FROM (SELECT x, min(x) OVER () AS low, max(x) OVER () AS high FROM (SELECT CAST(embedding[1] AS DOUBLE) AS x FROM embeddings))) GROUP BY bin), (VALUES ('single'), ('complete'), ('upgma'), ('wpgma'), ('upgmc'), ('wpgmc'), ('ward')) AS t(method)"),
        "colour_nop": (_coloured(colour.nop), f"{_MAPPER}SELECT cluster_id, -1 AS bin FROM clusters"),
        "colour_constant": (_coloured(colour.constantly(2)), f"{_MAPPER}SELECT cluster_id, 2 AS bin FROM clusters"),
        "colour_size": (_coloured(colour.cluster_size(9)), f"{_MAPPER}SELECT cluster_id, {_bin_sql('(size - low) / nullif(high - low, 0)', 9)} AS bin FROM clusters, (SELECT min(size) AS low, max(size) AS high FROM clusters)"),
        "colour_percentage": (_coloured(colour.cluster_percentage(7, _MACHINERY)), f"{_MAPPER}SELECT cluster_id, {_bin_sql('avg(CASE WHEN c_mktsegment = $$MACHINERY$$ THEN 1.0::DOUBLE ELSE 0 END)', 7)} AS bin FROM member JOIN ranged USING (i) GROUP BY cluster_id"),
        "colour_occurrence": (_coloured(colour.local_occurrence(_MACHINERY)), f"{_MAPPER}SELECT cluster_id, CASE WHEN bool_or(c_mktsegment = 'MACHINERY') THEN 0 ELSE -1 END AS bin FROM member JOIN ranged USING (i) GROUP BY cluster_id"),
        "colour_max_frequency": (_coloured(colour.cluster_max_frequency(9, "c_mktsegment")), f"{_MAPPER}, counted AS (SELECT cluster_id, c_mktsegment, count(*) AS n FROM member JOIN ranged USING (i) GROUP BY ALL), numbered AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS bin FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT cluster_id, bin FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, c_mktsegment) AS place FROM counted) JOIN numbered USING (c_mktsegment) WHERE place = 1"),
        "colour_average": (_coloured(colour.average_filter_value(9, L.Feature(0))), f"{_MAPPER}, means AS (SELECT cluster_id, avg(x - low) AS mean FROM member JOIN ranged USING (i) GROUP BY cluster_id) SELECT cluster_id, {_bin_sql('mean / nullif((SELECT max(mean) FROM means), 0)', 9)} AS bin FROM means"),
        "points_to_clusters": (lambda s, d: inspect.points_to_clusters(graph_1d(s, d).clusters).select("index", F.array_join("cluster_ids", ",").alias("cluster_ids")), f"{_MAPPER}SELECT i AS index, string_agg(cluster_id, ',' ORDER BY cluster_id) AS cluster_ids FROM member GROUP BY i"),
        "level_sets_to_clusters": (lambda s, d: inspect.level_sets_to_clusters(graph_1d(s, d).clusters).select(F.col("level_set")[0].alias("bin"), "least", "greatest", "clusters", F.array_join("cluster_ids", ",").alias("cluster_ids")), f"{_MAPPER}SELECT bin, min(list_min(members)) AS least, max(list_max(members)) AS greatest, count(*) AS clusters, string_agg(cluster_id, ',' ORDER BY cluster_id) AS cluster_ids FROM clusters GROUP BY bin"),
        "category_frequencies": (category_frequencies, f"{_MAPPER}SELECT cluster_id, c_mktsegment, count(*) AS n FROM member JOIN ranged USING (i) GROUP BY ALL"),
        "components": (components_1d, f"{_RECURSIVE}, both_ways AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), reach AS (SELECT cluster_id, cluster_id AS seen FROM clusters UNION SELECT r.cluster_id, b.dst FROM reach r JOIN both_ways b ON r.seen = b.src) SELECT cluster_id, min(seen) AS component FROM reach GROUP BY cluster_id"),
        "graph_export": (graph_export, f"{_MAPPER}SELECT cluster_id, CAST(size AS BIGINT) AS size, (SELECT count(*) FROM edges WHERE src = cluster_id OR dst = cluster_id) AS degree FROM clusters"),
        "knn_exact": (lambda s, d: _edges(_graph(s, d)), f"{_KNN}SELECT src, dst, round(distance, 6) AS distance FROM knn"),
        "knn_sampled": (lambda s, d: _edges(knn.sampled_knn(vectors(s, d), _K, D.EUCLIDEAN, amount=50)), f"{_KNN}SELECT src, dst, round(distance, 6) AS distance FROM knn WHERE src IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 50)"),
        "knn_symmetric_or_weighted": (_symmetric(), _symmetric_sql("d")),
        "knn_symmetric_or_unweighted": (_symmetric(weighted=False), _symmetric_sql("1.0::DOUBLE")),
        "knn_symmetric_or_halved": (_symmetric(halve=True), _symmetric_sql("CASE WHEN n = 1 THEN d / 2 ELSE d END")),
        "knn_symmetric_and_weighted": (_symmetric(mutual=True), _symmetric_sql("d", "n > 1")),
        "knn_symmetric_and_unweighted": (_symmetric(weighted=False, mutual=True), _symmetric_sql("1.0::DOUBLE", "n > 1")),
        "knn_accuracy": (knn_accuracy, f"{_KNN}, l1 AS (SELECT a.vec_id AS src, b.vec_id AS dst, {manhattan} AS d FROM v a, v b WHERE a.vec_id <> b.vec_id AND a.vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100)), near AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst DESC) AS place FROM l1) WHERE place <= {_K}) SELECT round(avg(share), 6) AS accuracy FROM (SELECT k.src, count(n.dst) / count(*) AS share FROM knn k LEFT JOIN near n ON k.src = n.src AND k.dst = n.dst GROUP BY k.src)"),
        "fast_knn": (fast_knn, "SELECT vec_id, CAST(10 AS BIGINT) AS neighbours, CAST(10 AS BIGINT) AS ranks, CAST(1 AS INT) AS true_distances FROM embeddings"),
        "fast_knn_jobs": (fast_knn_jobs, "SELECT CAST(1 AS INT) AS same"),
        "fast_knn_accuracy": (fast_knn_accuracy, "SELECT CAST(1 AS INT) AS accurate"),
        "affinity": (lambda s, d: _affinity(s, d).select("i", "j", _r("value").alias("value")), f"{_AFFINITY}SELECT i, j, round(value, 6) AS value FROM affinity"),
        "degrees": (lambda s, d: laplacian.degrees(_affinity(s, d)).select("i", _r("degree").alias("degree")), f"{_AFFINITY}SELECT i, round(degree, 6) AS degree FROM degree"),
        "laplacian_matrix": (lambda s, d: laplacian.normalised(_affinity(s, d)).select("i", "j", _r("value").alias("value")), f"{_AFFINITY}SELECT a.i, a.j, round(value / sqrt(x.degree * y.degree), 6) AS value FROM affinity a JOIN degree x ON a.i = x.i JOIN degree y ON a.j = y.i"),
        "laplacian_embedding": (laplacian_embedding, f"{_AFFINITY}SELECT i AS index, CAST(5 AS BIGINT) AS columns, 1.0::DOUBLE AS length FROM degree"),
        "tanimoto_embedding": (tanimoto_embedding, "SELECT vec_id AS index, CAST(3 AS BIGINT) AS columns, 1.0::DOUBLE AS length FROM embeddings"),
        "sketch_mean": (_sketched("mean"), f"{_signature_sql()}SELECT prototype, count(*) AS size, round(avg(e[1]), 4) AS x0 FROM s GROUP BY prototype"),
        "sketch_random": (_sketched("random"), f"{_signature_sql()}SELECT prototype, count(*) AS size, round(min_by(e[1], (CAST('0x' || substr(md5('0:' || vec_id), 1, 8) AS BIGINT), vec_id)), 4) AS x0 FROM s GROUP BY prototype"),
        "sketch_median": (sketch_median, f"{_signature_sql()}SELECT prototype, count(*) AS size, CAST(1 AS INT) AS member FROM s GROUP BY prototype"),
        "sketch_sizes": (sketch_sizes, f"{_signature_sql()}SELECT size, count(*) AS prototypes FROM (SELECT count(*) AS size FROM s GROUP BY prototype) GROUP BY size"),
        "sketch_lookup": (sketch_lookup, f"{_signature_sql()}SELECT vec_id, prototype FROM s"),
        "sketched_lens": (sketched_lens, f"{_signature_sql()}, m AS (SELECT prototype, list(x ORDER BY k) AS e FROM (SELECT prototype, k, avg(e[k]) AS x FROM s, (SELECT unnest(range(1, 65)) AS k) GROUP BY prototype, k) GROUP BY prototype), n AS (SELECT count(*) AS n FROM m), far AS (SELECT a.prototype, sum(list_distance(a.e, b.e)) / any_value(n) AS value FROM m a, m b, n WHERE a.prototype <> b.prototype GROUP BY a.prototype) SELECT vec_id, round(value, 4) AS value FROM s JOIN far USING (prototype)"),
        "session_steps": (session_steps, _SESSION),
        "read_csv": (read_csv, "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation"),
        "read_numbered": (read_numbered, "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS index, o_orderkey FROM orders"),
        "read_dropped": (read_dropped, "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100"),
        "read_dense": (read_dense, "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS index, CAST(c_acctbal AS DOUBLE) AS x, CAST(c_custkey AS DOUBLE) AS y FROM customer WHERE c_acctbal IS NOT NULL"),
        "read_labelled": (lambda s, d: _labelled(s, d, False), _LABELLED),
        "read_mixture": (lambda s, d: _labelled(s, d, True), _LABELLED),
        "read_sparse": (read_sparse, "WITH c AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CASE WHEN abs(x) > 0.1 THEN round(x, 4) ELSE 0.0 END) AS e FROM embeddings) SELECT row_number() OVER (ORDER BY vec_id) - 1 AS index, CAST(label AS VARCHAR) AS category, len(list_filter(e, lambda x: x <> 0)) AS entries, round(list_sum(e), 4) AS total, e[1] AS x0 FROM c"),
        "read_transposed": (read_transposed, "SELECT n_nationkey AS index, trim(n_name) AS nation, n_regionkey AS region, CAST(s AS INT) AS segment, n FROM nation JOIN (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey JOIN (SELECT c_mktsegment, row_number() OVER (ORDER BY trim(c_mktsegment)) - 1 AS s FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (c_mktsegment)"),
        "dot_lines": (dot_lines, f"{_NUMBERED}SELECT '  ' || number || ';' AS line FROM numbered UNION ALL SELECT '  ' || a.number || ' -- ' || b.number || ';' FROM edges JOIN numbered a ON src = a.cluster_id JOIN numbered b ON dst = b.cluster_id"),
        "graph_nodes": (graph_nodes, f"{_NUMBERED}SELECT cluster_id AS id, CAST(number AS VARCHAR) AS label, CAST(size AS BIGINT) AS size, CAST(bin AS DOUBLE) AS x, 0.0::DOUBLE AS y FROM numbered"),
        "graph_links": (graph_links, f"{_MAPPER}SELECT src || '-' || dst AS id, src AS source, dst AS target FROM edges"),
        "numbered_clusters": (numbered_clusters, f"{_NUMBERED}SELECT cluster_id, number FROM numbered"),
        "cluster_points": (cluster_points, f"{_MAPPER}SELECT cluster_id, array_to_string(members, ',') AS members FROM clusters"),
        "synthetic_graphs": (synthetic_graphs, "WITH n AS (SELECT count(*) AS n FROM nation), i AS (SELECT unnest(range(n)) AS src, n FROM n) SELECT 'loop' AS kind, src, (src + 1) % n AS dst FROM i UNION ALL SELECT 'star', src, 0 FROM i WHERE src <> 0"),
        "custom_lens": (custom_lens, f"WITH v AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey), r AS (SELECT x, min(x) OVER () AS low, max(x) OVER () AS high FROM v) SELECT bin, count(*) AS n FROM (SELECT {_cover_sql('x', 6, 0.5, 1)} AS bin FROM r) GROUP BY bin"),
        "frequencies": (frequencies, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type"),
        "lsh_signature_euclidean": _signatures("euclidean"),
        "lsh_signature_cosine": _signatures("cosine"),
        "lsh_signature_manhattan": _signatures("manhattan"),
        "sliding_pairs": (sliding_pairs, "SELECT user_id, event_type AS \"left\", next AS \"right\", count(*) AS n FROM (SELECT user_id, event_type, lead(event_type) OVER w AS next, lead(event_id) OVER w AS following FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE following IS NOT NULL GROUP BY ALL"),
        "merged_maps": (merged_maps, "SELECT c_nationkey, c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY ALL"),
        "average_by_key": (average_by_key, "SELECT c_mktsegment, round(avg(c_nationkey), 6) AS average FROM customer GROUP BY ALL"),
        "map_to_int": (map_to_int, "SELECT c_mktsegment, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS number, count(*) AS n FROM customer GROUP BY c_mktsegment"),
        "without_position": (without_position, f"{_V}SELECT vec_id, len(e) - 1 AS n, round(list_sum(e) - e[2], 6) AS total FROM v"),
        "prefix_order": (prefix_order, "WITH n AS (SELECT n_nationkey AS k, substr(n_name, 1, 4) AS x, substr(n_name, 1, 2) AS y FROM nation) SELECT a.k AS a, b.k AS b, CAST(sign(CASE WHEN substr(a.x, 1, 2) < b.y THEN -1 WHEN substr(a.x, 1, 2) > b.y THEN 1 ELSE 0 END) AS INT) AS sign FROM n a JOIN n b ON a.k < b.k"),
        "pair_columns": (pair_columns, "SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, CAST(abs(a.n_nationkey - b.n_nationkey) + abs(a.n_regionkey - b.n_regionkey) AS DOUBLE) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey"),
        "distance_matrix": (distance_matrix, "SELECT a.n_regionkey AS region, CAST(a.n_nationkey AS BIGINT) AS a, CAST(b.n_nationkey AS BIGINT) AS b, CAST(a.n_nationkey - b.n_nationkey AS DOUBLE) AS distance FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey > b.n_nationkey"),
        "palettes": (palettes, "SELECT scheme, n, CAST(k - 1 AS INT) AS k, colours[k] AS colour FROM (SELECT scheme, colours, n, unnest(range(1, n + 1)) AS k FROM (SELECT scheme, colours, CAST(unnest(range(3, len(colours) + 1)) AS INT) AS n FROM (VALUES " + ", ".join(f"('{name}', string_split('{c}', ' '))" for name, c in colour.QUALITATIVE.items()) + ") AS t(scheme, colours)))"),
        "dist_pearson": (_distance(D.PEARSON), _distance_sql(f"1 - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))", "WITH v AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)) ")),
        "dist_spearman": (_distance(D.SPEARMAN), _distance_sql(f"1 - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')}))", "WITH r AS (SELECT vec_id, list_transform(e, lambda x: len(list_filter(e, lambda y: y < x)) + (len(list_filter(e, lambda y: y = x)) - 1) / 2.0::DOUBLE) AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)), v AS (SELECT vec_id, list_transform(e, lambda x: x - list_avg(e)) AS e FROM r) ")),
        "pca_lens": (pca_lens, f"{_V}SELECT b.vec_id, round(pow(list_distance(a.e, b.e), 2), 4) AS square FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"),
        "pca_variances": (pca_variances, "SELECT CAST(1 AS INT) AS uncorrelated, CAST(1 AS INT) AS falling"),
        "laplacian_first": (lambda s, d: _first_vector(laplacian.singular_vectors(laplacian.normalised(_affinity(s, d)), 1)), f"{_AFFINITY}SELECT i AS index, round(sqrt(degree / (SELECT sum(degree) FROM degree)), 5) AS value FROM degree"),
        "tanimoto_first": (lambda s, d: _first_vector(laplacian.tanimoto_vectors(vectors(s, d), 1)), f"{_V}, w AS (SELECT a.vec_id AS i, sum(exp(-pow(1 - {dots[0]} / ({dots[1]} + {dots[2]} - {dots[0]}), 2) / 2)) AS degree FROM v a, v b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id) SELECT i AS index, round(sqrt(degree / (SELECT sum(degree) FROM w)), 5) AS value FROM w"),
        "mapper_laplacian": (mapper_laplacian, "SELECT vec_id, CAST(2 AS BIGINT) AS clusters FROM embeddings"),
        "mapper_nd": (mapper_nd, f"WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), r AS (SELECT vec_id, e, e[1] AS x0, list_avg(e) AS x1, min(e[1]) OVER () AS low0, max(e[1]) OVER () AS high0, min(list_avg(e)) OVER () AS low1, max(list_avg(e)) OVER () AS high1 FROM v), c AS (SELECT vec_id, e, bin0, {_cover_sql('x1', 3, 0.25, 1, '1')} AS bin1 FROM (SELECT *, {_cover_sql('x0', 4, 0.5, 1, '0')} AS bin0 FROM r)), pair AS (SELECT a.bin0, a.bin1, a.vec_id AS a, b.vec_id AS b FROM c a JOIN c b ON a.bin0 = b.bin0 AND a.bin1 = b.bin1 AND a.vec_id <> b.vec_id AND list_distance(a.e, b.e) < 1.25), reach AS (SELECT bin0, bin1, vec_id, vec_id AS seen FROM c UNION SELECT r.bin0, r.bin1, r.vec_id, p.b FROM reach r JOIN pair p ON r.bin0 = p.bin0 AND r.bin1 = p.bin1 AND r.seen = p.a) SELECT bin0, bin1, least, count(*) AS size FROM (SELECT bin0, bin1, vec_id, min(seen) AS least FROM reach GROUP BY ALL) GROUP BY bin0, bin1, least"),
        "knn_fraction": (knn_fraction, f"{_KNN}SELECT src, dst, round(distance, 6) AS distance FROM knn WHERE CAST('0x' || substr(md5('5:' || src), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.2"),
        "event_runs": (event_runs, "WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN lag(event_id) OVER w IS NULL OR lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT user_id, event_type, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM m) SELECT user_id, run, event_type, count(*) AS n FROM r GROUP BY ALL"),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph of the embeddings under one lens."""
    g = run_mapper(vectors(spark, sf_dir), Params((Filter(L.Feature(0), 10, 0.5),), D.EUCLIDEAN, scale=FirstGap(10)))
    return g.clusters.select("cluster_id", F.col("level_set")[0].alias("bin"), F.col("size").cast("long").alias("size"))


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}
