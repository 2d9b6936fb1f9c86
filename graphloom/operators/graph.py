"""Graph preparation and measures on DataFrames.

edges  (src, dst, w): one row for each undirected edge as read
arcs   (src, dst, w): both directions of every edge, a loop once
nodes  (id, node_w):  all vertices, with the number of original vertices each stands for
labels (id, comm):    a partition of the nodes
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.plans.store import materialize, small


def with_weight(edges: DataFrame) -> DataFrame:
    """Edges with weights; 1 where there is none."""
    if "w" not in edges.columns:
        edges = edges.withColumn("w", F.lit(1.0))
    return edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")


def symmetrise(edges: DataFrame, loops_twice: bool = False) -> DataFrame:
    """Both directions of every edge; a loop stays one arc, or two (loops_twice).

    One pass over the edges: the second direction is made by a generator, not by a second scan.
    """
    there = F.struct(F.col("src"), F.col("dst"))
    back = F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = F.array(there, back)
    ends = F.explode(both if loops_twice else F.when(F.col("src") == F.col("dst"), F.array(there)).otherwise(both))
    return edges.select(ends.alias("e"), "w").select("e.src", "e.dst", "w")


def clean_unweighted(arcs: DataFrame) -> DataFrame:
    """One copy of each arc, with weight 1."""
    return arcs.select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long"))


def clean_weighted(arcs: DataFrame) -> DataFrame:
    """Copies of an arc become one, with the sum of their weights."""
    return arcs.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def arcs_of(edges: DataFrame, weighted: bool = False) -> DataFrame:
    arcs = symmetrise(with_weight(edges))
    return clean_weighted(arcs) if weighted else clean_unweighted(arcs)


def nodes_of(arcs: DataFrame) -> DataFrame:
    """Vertices 0 to the largest id of materialized arcs; gaps are isolated vertices.  One row is collected, the vertices are made in many tasks."""
    top = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return vertex_range(arcs.sparkSession, 0, -1 if top is None else top)


def vertex_range(spark, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).select("id", F.lit(1).cast("long").alias("node_w"))


def _in_ranges(df: DataFrame, column: str) -> DataFrame:
    """df dealt to ranges of a column by sampled bounds, with the range's number (__part): about as many rows in each, whatever the values."""
    return materialize(df.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "ranges")


def _before(sizes: DataFrame, value: str) -> DataFrame:
    """(__part, __before): sums of the ranges before; one row for each range is summed in one place."""
    before = F.coalesce(F.sum(value).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return F.broadcast(sizes.select("__part", before.alias("__before")))


def dense_ids(ids: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): distinct integer ids numbered from 0 in ascending order.

    Ids are numbered inside ranges and moved by the number of ids in the ranges before, so no task sorts more than a range.
    """
    distinct = _in_ranges(ids.select(column).filter(F.col(column).isNotNull()).distinct(), column)
    starts = _before(distinct.groupBy("__part").agg(F.count("*").alias("__n")), "__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1
    return distinct.withColumn("__rank", rank).join(starts, "__part").select(column, (F.col("__before") + F.col("__rank")).cast("long").alias(name))


def renumber_map(arcs: DataFrame) -> DataFrame:
    """(old_id, new_id) of the vertices that have an arc."""
    return dense_ids(arcs.select(F.col("src").alias("old_id")), "old_id", "new_id")


def renumber(arcs: DataFrame, mapping: DataFrame) -> DataFrame:
    src = mapping.select(F.col("old_id").alias("src"), F.col("new_id").alias("s"))
    dst = mapping.select(F.col("old_id").alias("dst"), F.col("new_id").alias("d"))
    return arcs.join(src, "src").join(dst, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "w")


def simplify(edges: DataFrame) -> DataFrame:
    """Undirected edges without loops and copies, the smaller end first."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def add_self_loops(arcs: DataFrame, nodes: DataFrame, weight: float | int = 1) -> DataFrame:
    """A loop for every vertex that has none."""
    loops = arcs.filter("src = dst").select(F.col("src").alias("id"))
    kind = dict(arcs.dtypes)["w"]
    missing = nodes.select("id").join(loops, "id", "left_anti")
    return arcs.select("src", "dst", "w").union(missing.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(weight).cast(kind)))


def asymmetric_arcs(arcs: DataFrame) -> DataFrame:
    """(src, dst, w, reverse_w): arcs whose reverse is missing or has another weight."""
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("reverse_w"))
    return arcs.join(back, ["src", "dst"], "left").filter(~F.col("w").eqNullSafe(F.col("reverse_w")))


def is_symmetric(arcs: DataFrame) -> bool:
    return not asymmetric_arcs(arcs).head(1)


def assign_node_weight(nodes: DataFrame, weights: DataFrame) -> DataFrame:
    """Nodes with the weights (id, node_w) of some replaced."""
    new = weights.select("id", F.col("node_w").alias("__new"))
    return nodes.join(new, "id", "left").select("id", F.coalesce("__new", "node_w").alias("node_w"))


def drop_marked(df: DataFrame, column: str, mark: int = -1) -> DataFrame:
    """Rows that aren't marked as removed."""
    return df.filter(F.col(column) != mark)


# measures


def degrees(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, weighted_degree, loop_w) of all nodes; a loop counts once."""
    loop = F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(F.lit(0))
    d = arcs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.sum("w").alias("weighted_degree"), F.sum(loop).alias("loop_w"))
    zero = F.lit(0)
    kind = "double" if dict(arcs.dtypes)["w"] in ("double", "float") else "long"
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", zero).cast("long").alias("degree"), F.coalesce("weighted_degree", zero).cast(kind).alias("weighted_degree"), F.coalesce("loop_w", zero).cast(kind).alias("loop_w"))


def self_loops(arcs: DataFrame) -> DataFrame:
    return arcs.filter("src = dst").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("loop_w"))


def neighbours(arcs: DataFrame, id_: int) -> DataFrame:
    return arcs.filter(F.col("src") == id_).select(F.col("dst").alias("id"), "w")


def total_weight(arcs: DataFrame) -> DataFrame:
    return arcs.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("m2"))


def max_weight(arcs: DataFrame) -> DataFrame:
    return arcs.agg(F.coalesce(F.max("w"), F.lit(1)).alias("max_w"))


def max_degree(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_degree"))


def running_total(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Sums of value up to and with each unique key, by ranges as in dense_ids."""
    ranges = _in_ranges(df, key)
    starts = _before(ranges.groupBy("__part").agg(F.sum(value).alias("__n")), "__n")
    inside = F.sum(value).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.withColumn("__inside", inside).join(starts, "__part").withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__part", "__inside", "__before")


def csr_offsets(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, cumulative_degree): the offsets of a compressed adjacency array."""
    return running_total(degrees(arcs, nodes).select("id", "degree"), "id", "degree", "cumulative_degree")


def adjacency_lists(arcs: DataFrame) -> DataFrame:
    """(id, neighbours): array of (dst, w), by dst."""
    return arcs.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list(F.struct("dst", "w"))).alias("neighbours"))


def half_edges(arcs: DataFrame) -> DataFrame:
    """Each non-loop edge once, the larger end first."""
    return arcs.filter("src > dst")


# joins with a partition


def with_label(df: DataFrame, labels: DataFrame, id_: str, name: str) -> DataFrame:
    """df with the community of each id_; ids may be hubs: small labels are broadcast."""
    return df.join(small(labels.select(F.col("id").alias(id_), F.col("comm").alias(name))), id_)


def community_weights(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comm, dnc): weight from each vertex to each adjacent community, loops left out; its own is always there."""
    out = with_label(arcs.filter("src <> dst"), labels, "dst", "comm").groupBy(F.col("src").alias("id"), "comm").agg(F.sum("w").alias("dnc"))
    own = labels.select("id", "comm", F.lit(0).cast(dict(out.dtypes)["dnc"]).alias("dnc"))
    return out.union(own).groupBy("id", "comm").agg(F.sum("dnc").alias("dnc"))


def own_weights(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, own_w): weight from each vertex to its own community, its loop included."""
    both = with_label(with_label(arcs, labels, "src", "cs"), labels, "dst", "cd")
    own = both.filter("cs = cd").groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("own_w"))
    return labels.select("id").join(own, "id", "left").withColumn("own_w", F.coalesce("own_w", F.lit(0)))


def community_stats(arcs: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(comm, in_w, tot_w, node_w, size): arcs inside (an edge twice, a loop once), arcs from it, vertices."""
    both = with_label(with_label(arcs, labels, "src", "comm"), labels, "dst", "cd")
    inside: Column = F.when(F.col("comm") == F.col("cd"), F.col("w")).otherwise(F.lit(0))
    weights = both.groupBy("comm").agg(F.sum(inside).alias("in_w"), F.sum("w").alias("tot_w"))
    kind = "double" if dict(arcs.dtypes)["w"] in ("double", "float") else "long"
    members = nodes.join(labels, "id").groupBy("comm").agg(F.sum("node_w").alias("node_w"), F.count("*").alias("size"))
    return members.join(weights, "comm", "left").select("comm", F.coalesce("in_w", F.lit(0)).cast(kind).alias("in_w"), F.coalesce("tot_w", F.lit(0)).cast(kind).alias("tot_w"), F.col("node_w").cast("long").alias("node_w"), "size")
