"""From level sets to the graph: local clusters, collapsed duplicates, nerve edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.functions.distances import DEFAULT, Distance
from simplicia.functions.linkage import Provider, cluster, local_labels
from simplicia.functions.scale import Histogram, Selector


def dendrograms(level_sets: DataFrame, distance: Distance = DEFAULT, method: str = "single", provider: Provider = cluster) -> DataFrame:
    """level_set, members (index in order), heights, merges (pairs, flat) and diameter of every cell, to be cut many times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        tree = provider(np.stack(pdf["features"].to_list()), distance, method)
        return pd.DataFrame({"level_set": [pdf["level_set"].iloc[0]], "members": [pdf["index"].to_numpy()], "heights": [tree.heights], "merges": [tree.merges.ravel()], "diameter": [tree.diameter]})

    rows = level_sets.select("level_set", "index", "features")
    return rows.groupBy("level_set").applyInPandas(run, "level_set array<int>, members array<long>, heights array<double>, merges array<int>, diameter double")


def cut(trees: DataFrame, scale: Selector = Histogram()) -> DataFrame:
    """level_set, label, index from stored dendrograms: no distances are computed again."""
    from simplicia.functions.linkage import Dendrogram

    def run(batches):
        for pdf in batches:
            out = []
            for cell, members, heights, merges, diameter in zip(pdf["level_set"], pdf["members"], pdf["heights"], pdf["merges"], pdf["diameter"], strict=True):
                tree = Dendrogram(len(members), np.asarray(merges, int).reshape(-1, 2), np.asarray(heights, float), diameter)
                labels = tree.labels(scale(tree.all_heights()))
                out.append(pd.DataFrame({"level_set": [cell] * len(members), "label": labels, "index": members}))
            yield pd.concat(out) if out else pd.DataFrame({"level_set": [], "label": [], "index": []})

    return trees.mapInPandas(run, "level_set array<int>, label int, index long")


def local_clusters(level_sets: DataFrame, distance: Distance = DEFAULT, method: str = "single", scale: Selector = Histogram(), provider: Provider = cluster) -> DataFrame:
    """level_set, label, index: clustering and cut of every cell in one step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        labels = local_labels(np.stack(pdf["features"].to_list()), distance, method, scale, provider)
        return pd.DataFrame({"level_set": list(pdf["level_set"]), "label": labels, "index": pdf["index"].to_numpy()})

    return level_sets.select("level_set", "index", "features").groupBy("level_set").applyInPandas(run, "level_set array<int>, label int, index long")


def form_clusters(labelled: DataFrame, collapse: bool = True) -> DataFrame:
    """cluster_id, level_set, members, size. Clusters of the same members collapse to the one of the smallest level set.

    Ids are hashes of level set and members: the same graph has the same ids in every run."""
    found = labelled.groupBy("level_set", "label").agg(F.sort_array(F.collect_list("index")).alias("members"))
    if collapse:
        found = found.groupBy("members").agg(F.min("level_set").alias("level_set"))
    name = F.md5(F.concat_ws(":", F.array_join(F.col("level_set").cast("array<string>"), ","), F.array_join(F.col("members").cast("array<string>"), ",")))
    return found.select(name.alias("cluster_id"), "level_set", "members", F.size("members").alias("size"))


def memberships(clusters: DataFrame) -> DataFrame:
    """cluster_id, size, index."""
    return clusters.select("cluster_id", "size", F.explode("members").alias("index"))


def nerve(clusters: DataFrame) -> DataFrame:
    """src, dst, shared: clusters with common points, the larger (then the smaller id) first.

    A point is in few clusters (a constant of the cover), so the join by point has few rows for each."""
    m = memberships(clusters)
    a, b = (m.select("index", F.struct((-F.col("size")).alias("s"), F.col("cluster_id").alias("id")).alias(x)) for x in ("a", "b"))
    return a.join(b, "index").where("a < b").groupBy(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).agg(F.count("*").alias("shared"))
