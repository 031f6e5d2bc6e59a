"""The thresholded similarity graph, its components, and statistics of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskin.operators.overlap import THRESHOLD
from corpuskin.plans.shared import connected_components, ranked


def similarity_edges(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, score) of pairs that score at least ``threshold``."""
    return scores.where(F.col("score") >= threshold).select("a", "b", "score")


def graph_nodes(files: DataFrame, edges: DataFrame) -> DataFrame:
    """All files, and endpoints of edges that are not among them."""
    return files.select("file_id").union(edges.select("a")).union(edges.select("b")).distinct()


def node_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("file_id")).union(edges.select(F.col("b").alias("file_id")))
    return nodes.join(both.groupBy("file_id").agg(F.count("*").alias("degree")), "file_id", "left").fillna(0, ["degree"])


def edge_count(edges: DataFrame) -> DataFrame:
    """(n_edges)."""
    return edges.agg(F.count("*").alias("n_edges"))


def clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_id, cluster_id): connected components, numbered from 0 by their smallest member. Isolated nodes are clusters of one."""
    found = connected_components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    placed = nodes.join(found.select(F.col("node").alias("file_id"), "component"), "file_id", "left")
    placed = placed.select("file_id", F.coalesce("component", "file_id").alias("component"))
    firsts = placed.where("file_id = component").select("component", F.lit(0).alias("_all"))
    numbered = ranked(firsts, "_all", ["component"], "cluster_id", "clusters").select("component", "cluster_id")
    return placed.join(numbered, "component").select("file_id", "cluster_id")


def cluster_stats(members: DataFrame, entries: DataFrame, scores: DataFrame) -> DataFrame:
    """(cluster_id, member_count, is_singleton, total_bytes, min_score, max_score, avg_score) over pairs within the cluster.

    Pairs without a score count as 0: they enter by their number, so that no pairs are listed. Null for clusters of one.
    """
    size = members.join(entries, "file_id", "left").groupBy("cluster_id")
    size = size.agg(F.count("*").alias("member_count"), F.coalesce(F.sum("eligible_bytes"), F.lit(0)).alias("total_bytes"))
    a = members.select(F.col("file_id").alias("a"), F.col("cluster_id").alias("cluster_id"))
    b = members.select(F.col("file_id").alias("b"), F.col("cluster_id").alias("_cb"))
    within = scores.join(a, "a").join(b, "b").where("cluster_id = _cb").groupBy("cluster_id")
    within = within.agg(F.count("*").alias("_n"), F.min("score").alias("_min"), F.max("score").alias("_max"), F.sum("score").alias("_sum"))
    joined = size.join(within, "cluster_id", "left").fillna(0, ["_n"])
    pairs = F.col("member_count") * (F.col("member_count") - 1) / 2
    some = F.col("member_count") > 1
    missing = F.col("_n") < pairs
    zero = F.lit(0.0)
    return joined.select(
        "cluster_id",
        "member_count",
        (F.col("member_count") == 1).alias("is_singleton"),
        "total_bytes",
        F.when(some, F.when(missing, F.least(zero, F.coalesce("_min", zero))).otherwise(F.col("_min"))).alias("min_score"),
        F.when(some, F.when(missing, F.greatest(zero, F.coalesce("_max", zero))).otherwise(F.col("_max"))).alias("max_score"),
        F.when(some, F.coalesce("_sum", zero) / pairs).alias("avg_score"),
    )
