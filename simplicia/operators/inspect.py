"""What is in a graph: numbers, memberships, components, exports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.operators.mapper import memberships
from simplicia.sources.readers import with_index
from simplicia.storage import cut_lineage


def numbered_clusters(clusters: DataFrame) -> DataFrame:
    """``clusters`` with ``number``: dense from 0, by level set, members and id."""
    return with_index(clusters, "level_set", "members", "cluster_id", name="number")


def cluster_points(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.sort_array("members").alias("members"))


def level_sets_to_clusters(clusters: DataFrame) -> DataFrame:
    """level_set, least and greatest member, number of clusters and their ids."""
    return clusters.groupBy("level_set").agg(
        F.min(F.array_min("members")).alias("least"), F.max(F.array_max("members")).alias("greatest"), F.count("*").alias("clusters"), F.sort_array(F.collect_list("cluster_id")).alias("cluster_ids")
    )


def points_to_clusters(clusters: DataFrame) -> DataFrame:
    return memberships(clusters).groupBy("index").agg(F.sort_array(F.collect_list("cluster_id")).alias("cluster_ids"))


def category_frequencies(points: DataFrame, clusters: DataFrame, category: str) -> DataFrame:
    return memberships(clusters).join(points.select("index", category), "index").groupBy("cluster_id", category).agg(F.count("*").alias("n"))


def components(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster_id, component (smallest id reachable): every round takes the least label of neighbours, then that label's own.

    Labels are checkpointed in each round, so plans stay short and lost executors cost one round."""
    both = cut_lineage(edges.select("src", "dst").union(edges.select("dst", "src")))
    labels = cut_lineage(clusters.select("cluster_id", F.col("cluster_id").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("cluster_id", "dst"), "dst").groupBy(F.col("src").alias("cluster_id")).agg(F.min("component").alias("seen"))
        new = labels.join(near, "cluster_id", "left").select("cluster_id", F.least("component", F.coalesce("seen", "component")).alias("component"))
        jump = labels.select(F.col("cluster_id").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(new.join(jump, "component").select("cluster_id", F.least("component", "further").alias("component")))
        if new.join(labels, ["cluster_id", "component"], "left_anti").isEmpty():
            return new
        labels = new


def graph_nodes(clusters: DataFrame) -> DataFrame:
    """id, label, size, x, y of every node: the label is its number, x and y the first and last bin."""
    at = F.col("level_set")
    return numbered_clusters(clusters).select(
        F.col("cluster_id").alias("id"), F.col("number").cast("string").alias("label"), F.col("size").cast("long").alias("size"),
        at[0].cast("double").alias("x"), F.when(F.size(at) > 1, F.element_at(at, -1)).otherwise(0).cast("double").alias("y"),
    )


def graph_links(edges: DataFrame) -> DataFrame:
    """id, source, target of every edge."""
    return edges.select(F.concat_ws("-", "src", "dst").alias("id"), F.col("src").alias("source"), F.col("dst").alias("target"))


def dot_lines(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """line, with a node's number or an edge's two: the graph in DOT without its braces, for graphs too large for the driver."""
    number = numbered_clusters(clusters).select("cluster_id", "number")
    a, b = (number.select(F.col("cluster_id").alias(end), F.col("number").alias(x)) for end, x in (("src", "a"), ("dst", "b")))
    lines = edges.select("src", "dst").join(a, "src").join(b, "dst").select(F.format_string("  %d -- %d;", "a", "b").alias("line"))
    return number.select(F.format_string("  %d;", "number").alias("line")).unionByName(lines)


def to_graph_dict(clusters: DataFrame, edges: DataFrame) -> dict:
    """Nodes and edges for a drawing: id, label, size, x, y; id, source, target. Collects the graph, which is what one draws."""
    nodes = sorted((r.asDict() for r in graph_nodes(clusters).collect()), key=lambda r: int(r["label"]))
    return {"nodes": nodes, "edges": [r.asDict() for r in graph_links(edges).orderBy("source", "target").collect()]}


def to_json(clusters: DataFrame, edges: DataFrame) -> str:
    return json.dumps(to_graph_dict(clusters, edges))


def to_dot(clusters: DataFrame, edges: DataFrame, name: str = "graph") -> str:
    """The graph in DOT."""
    lines = [r.line for r in dot_lines(clusters, edges).collect()]
    order = sorted(lines, key=lambda x: ("--" in x, [int(n) for n in x.strip(" ;").split(" -- ")]))
    return "\n".join([f"graph {name} {{", *order, "}"])
