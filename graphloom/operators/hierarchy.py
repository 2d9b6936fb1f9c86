"""Inspection of a hierarchy (level, node, comm): levels, flattening, co-membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators import louvain

C = F.col


def level_stats(hierarchy: DataFrame) -> DataFrame:
    """(level, nodes)."""
    return hierarchy.groupBy("level").agg(F.count("*").alias("nodes"))


def count_levels(hierarchy: DataFrame) -> int:
    top = hierarchy.agg(F.max("level")).first()[0]
    return 0 if top is None else top + 1


def labels_of_level(hierarchy: DataFrame, level: int) -> DataFrame:
    return hierarchy.filter(C("level") == level).select(C("node").alias("id"), "comm")


def flatten(hierarchy: DataFrame, level: int | None = None) -> DataFrame:
    """(id, comm) of the original vertices after `level` levels (all by default); level 0 is each vertex by itself."""
    n = count_levels(hierarchy)
    level = n if level is None else level
    if not 0 <= level <= n:
        raise ValueError(f"level {level} of a hierarchy with {n} levels")
    first = labels_of_level(hierarchy, 0)
    labels = first.select("id", C("id").alias("comm"))
    for i in range(level):
        labels = louvain.compose(labels, labels_of_level(hierarchy, i))
    return labels


def comembership_pairs(labels: DataFrame) -> DataFrame:
    """(a, b), a < b: vertices in the same community; the sparse form of the matrix."""
    a, b = labels.select(C("id").alias("a"), "comm"), labels.select(C("id").alias("b"), "comm")
    return a.join(b, "comm").filter("a < b").select("a", "b")


#: Vertices for which the dense matrix is made at most.
DENSE_VERTICES = 2_000


def comembership_matrix(labels: DataFrame) -> DataFrame:
    """(a, b, same) for all pairs of a small graph's vertices; larger graphs have comembership_pairs."""
    n = labels.count()
    if n > DENSE_VERTICES:
        raise ValueError(f"{n} vertices; a dense matrix is made for {DENSE_VERTICES} at most")
    side = F.broadcast(labels.select(C("id").alias("b"), C("comm").alias("cb")))
    return labels.select(C("id").alias("a"), C("comm").alias("ca")).crossJoin(side).select("a", "b", (C("ca") == C("cb")).cast("int").alias("same"))


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """(comm, size)."""
    return labels.groupBy("comm").agg(F.count("*").alias("size"))


def community_members(labels: DataFrame) -> DataFrame:
    """(comm, members): sorted ids."""
    return labels.groupBy("comm").agg(F.sort_array(F.collect_list("id")).alias("members"))
