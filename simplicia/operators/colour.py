"""Node attributes: a bin of a palette for each cluster, or none.

Each colouring takes (points, clusters) and returns cluster_id, bin (int, null for none)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplicia.functions.filters import Lens
from simplicia.functions.scalars import to_bin
from simplicia.operators.mapper import memberships

Colouring = Callable[[DataFrame, DataFrame], DataFrame]

# End and middle colours of public colour schemes, from which a palette of any size is interpolated.
ANCHORS = {
    "Blues": ("#f7fbff", "#6baed6", "#08306b"), "Greens": ("#f7fcf5", "#74c476", "#00441b"), "Greys": ("#ffffff", "#969696", "#000000"), "Oranges": ("#fff5eb", "#fd8d3c", "#7f2704"),
    "Purples": ("#fcfbfd", "#9e9ac8", "#3f007d"), "Reds": ("#fff5f0", "#fb6a4a", "#67000d"), "BuGn": ("#f7fcfd", "#66c2a4", "#00441b"), "BuPu": ("#f7fcfd", "#8c96c6", "#4d004b"),
    "GnBu": ("#f7fcf0", "#7bccc4", "#084081"), "OrRd": ("#fff7ec", "#fc8d59", "#7f0000"), "PuBu": ("#fff7fb", "#74a9cf", "#023858"), "PuBuGn": ("#fff7fb", "#67a9cf", "#014636"),
    "PuRd": ("#f7f4f9", "#df65b0", "#67001f"), "RdPu": ("#fff7f3", "#f768a1", "#49006a"), "YlGn": ("#ffffe5", "#78c679", "#004529"), "YlGnBu": ("#ffffd9", "#41b6c4", "#081d58"),
    "YlOrBr": ("#ffffe5", "#fe9929", "#662506"), "YlOrRd": ("#ffffcc", "#fd8d3c", "#800026"), "BrBG": ("#543005", "#f5f5f5", "#003c30"), "PiYG": ("#8e0152", "#f7f7f7", "#276419"),
    "PRGn": ("#40004b", "#f7f7f7", "#00441b"), "PuOr": ("#7f3b08", "#f7f7f7", "#2d004b"), "RdBu": ("#67001f", "#f7f7f7", "#053061"), "RdGy": ("#67001f", "#ffffff", "#1a1a1a"),
    "RdYlBu": ("#a50026", "#ffffbf", "#313695"), "RdYlGn": ("#a50026", "#ffffbf", "#006837"), "Spectral": ("#9e0142", "#ffffbf", "#5e4fa2"),
}


# The public qualitative schemes. Their smaller sizes are their beginnings.
QUALITATIVE = {
    "Accent": "#7fc97f #beaed4 #fdc086 #ffff99 #386cb0 #f0027f #bf5b17 #666666",
    "Dark2": "#1b9e77 #d95f02 #7570b3 #e7298a #66a61e #e6ab02 #a6761d #666666",
    "Paired": "#a6cee3 #1f78b4 #b2df8a #33a02c #fb9a99 #e31a1c #fdbf6f #ff7f00 #cab2d6 #6a3d9a #ffff99 #b15928",
    "Pastel1": "#fbb4ae #b3cde3 #ccebc5 #decbe4 #fed9a6 #ffffcc #e5d8bd #fddaec #f2f2f2",
    "Pastel2": "#b3e2cd #fdcdac #cbd5e8 #f4cae4 #e6f5c9 #fff2ae #f1e2cc #cccccc",
    "Set1": "#e41a1c #377eb8 #4daf4a #984ea3 #ff7f00 #ffff33 #a65628 #f781bf #999999",
    "Set2": "#66c2a5 #fc8d62 #8da0cb #e78ac3 #a6d854 #ffd92f #e5c494 #b3b3b3",
    "Set3": "#8dd3c7 #ffffb3 #bebada #fb8072 #80b1d3 #fdb462 #b3de69 #fccde5 #d9d9d9 #bc80bd #ccebc5 #ffed6f",
}


def palette(name: str, n: int, table: dict[str, dict[int, list[str]]] | None = None) -> list[str]:
    """n colours of a scheme: of a table if given, a qualitative scheme's first n, or interpolated between a scheme's anchors.

    The printed sequential and diverging schemes differ a little from the interpolation; who needs them passes their table."""
    if table is not None:
        return list(table[name][n])
    if name in QUALITATIVE:
        colours = QUALITATIVE[name].split()
        if n > len(colours):
            raise ValueError(f"{name} has {len(colours)} colours")
        return colours[:n]
    stops = [[int(c[i : i + 2], 16) for i in (1, 3, 5)] for c in ANCHORS[name]]
    out = []
    for k in range(n):
        t = k / max(1, n - 1) * (len(stops) - 1)
        i = min(int(t), len(stops) - 2)
        out.append("#" + "".join(f"{round(a + (b - a) * (t - i)):02x}" for a, b in zip(stops[i], stops[i + 1], strict=True)))
    return out


def paint(coloured: DataFrame, colours: list[str]) -> DataFrame:
    """``colour``: the palette's entry of each bin."""
    return coloured.withColumn("colour", F.get(F.array(*map(F.lit, colours)), F.col("bin")))


def nop(points: DataFrame, clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.lit(None).cast("int").alias("bin"))


def constantly(bin_: int = 0) -> Colouring:
    return lambda points, clusters: clusters.select("cluster_id", F.lit(bin_).alias("bin"))


def cluster_size(bins: int) -> Colouring:
    """Bin of (size - least) / (largest - least)."""

    def run(points, clusters):
        ends = clusters.agg(F.min("size").alias("low"), F.max("size").alias("high"))  # one row
        share = (F.col("size") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))
        return clusters.crossJoin(F.broadcast(ends)).select("cluster_id", to_bin(F.coalesce(share, F.lit(0.0)), bins).alias("bin"))

    return run


def _with_points(points: DataFrame, clusters: DataFrame, value: Column) -> DataFrame:
    return memberships(clusters).join(points.select("index", value.alias("value")), "index").select("cluster_id", "value")


def _column(x: Column | str) -> Column:
    """A column, or a SQL expression that needs no session before it is used."""
    return F.expr(x) if isinstance(x, str) else x


def cluster_percentage(bins: int, predicate: Column | str) -> Colouring:
    """Bin of the share of members that satisfy a predicate on points."""
    return lambda points, clusters: _with_points(points, clusters, F.coalesce(_column(predicate), F.lit(False)).cast("double")).groupBy("cluster_id").agg(to_bin(F.avg("value"), bins).alias("bin"))


def local_occurrence(predicate: Column | str) -> Colouring:
    """Bin 0 if any member satisfies the predicate, else none."""
    return lambda points, clusters: _with_points(points, clusters, F.coalesce(_column(predicate), F.lit(False))).groupBy("cluster_id").agg(F.when(F.bool_or("value"), 0).alias("bin"))


def cluster_max_frequency(bins: int, category: Column | str, numbers: dict[str, int] | None = None) -> Colouring:
    """Number of the most frequent category, the first of equals. Without ``numbers`` categories are numbered in order."""

    def run(points, clusters):
        if numbers is None:
            named = points.select(_column(category).cast("string").alias("value")).distinct().dropna()
            found = {r[0]: i for i, r in enumerate(named.orderBy("value").limit(bins + 1).collect())}
        else:
            found = numbers
        if len(found) > bins:
            raise ValueError("more categories than colours")
        counts = _with_points(points, clusters, _column(category).cast("string")).groupBy("cluster_id", "value").count()
        first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("count"), "value"))
        number = F.create_map(*[x for k, v in found.items() for x in (F.lit(k), F.lit(v))])[F.col("value")] if found else F.lit(None).cast("int")
        return counts.withColumn("place", first).where("place = 1").select("cluster_id", number.alias("bin"))

    return run


def average_filter_value(bins: int, lens: Lens) -> Colouring:
    """Bin of the mean of (value - least value), over the largest such mean. The lens is computed here, in the cover or not."""

    def run(points, clusters):
        values = lens.frame(points)
        low = values.agg(F.min("value").alias("low"))  # one row
        means = memberships(clusters).join(values, "index").crossJoin(F.broadcast(low)).groupBy("cluster_id").agg(F.avg(F.col("value") - F.col("low")).alias("mean"))
        top = means.agg(F.max("mean").alias("top"))  # one row
        return means.crossJoin(F.broadcast(top)).select("cluster_id", to_bin(F.coalesce(F.col("mean") / F.nullif("top", F.lit(0.0)), F.lit(0.0)), bins).alias("bin"))

    return run
