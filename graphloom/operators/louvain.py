"""Local moves, contraction and level composition as DataFrame operators.

Gains are compared as integers where weights are integers: with m2 the total weight, a move of v from its community to c
changes the quality by 2 g / m2^2, g = m2 (e_vc - e_own) + k ((tot_own - k) - tot_c).  Ties go to the lower id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.functions.local_louvain import BUCKET_TOPS
from graphloom.operators import graph
from graphloom.plans.store import materialize, small

C = F.col


def identity_labels(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", C("id").alias("comm"))


def degree_bucket(degree: Column) -> Column:
    """0 for isolated vertices, else 1 to 7; upper bounds belong to their bucket."""
    out = F.when(degree == 0, F.lit(0))
    for i, top in enumerate(BUCKET_TOPS):
        out = out.when(degree <= top, F.lit(i + 1))
    return out.otherwise(F.lit(len(BUCKET_TOPS) + 1))


def degree_buckets(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree, k, bucket)."""
    d = graph.degrees(arcs, nodes)
    return d.select("id", "degree", C("weighted_degree").alias("k"), degree_bucket(C("degree")).alias("bucket"))


def community_totals(vertices: DataFrame, labels: DataFrame) -> DataFrame:
    """(comm, tot, size) from vertices (id, k)."""
    return vertices.join(labels, "id").groupBy("comm").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))


def candidate_gains(arcs: DataFrame, vertices: DataFrame, labels: DataFrame, m2: Column, who: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """(id, comm, g): the net gain of each admissible move, for the vertices in `who` (all that arcs start from by default) and, if given, the (id, comm) in `allowed`."""
    used = arcs if who is None else arcs.join(small(who.select(C("id").alias("src"))), "src", "left_semi")
    near = graph.with_label(used.filter("src <> dst"), labels, "dst", "comm").groupBy(C("src").alias("id"), "comm").agg(F.sum("w").alias("e"))
    if allowed is not None:
        near = near.join(allowed, ["id", "comm"], "left_semi")
    totals = community_totals(vertices, labels)
    own = labels.select("id", C("comm").alias("cur")).join(vertices.select("id", "k"), "id")
    rows = near.join(own, "id")
    # the weight to the own community stands in one of the vertex's own groups
    mine = F.sum(F.when(C("comm") == C("cur"), C("e"))).over(Window.partitionBy("id"))
    rows = rows.withColumn("e_own", mine).filter(C("comm") != C("cur"))
    rows = rows.join(totals, "comm").join(totals.select(C("comm").alias("cur"), C("tot").alias("tot_cur"), C("size").alias("size_cur")), "cur")
    rows = rows.filter((C("comm") < C("cur")) | (C("size") > 1) | (C("size_cur") > 1))
    g = m2 * (C("e") - F.coalesce(C("e_own"), F.lit(0))) + C("k") * ((C("tot_cur") - C("k")) - C("tot"))
    return rows.select("id", "comm", g.alias("g"))


def best_of(gains: DataFrame) -> DataFrame:
    """(id, comm, g): the best move of each vertex, the lower community first among equals; only moves that gain."""
    kind = dict(gains.dtypes)["g"]
    g = F.round("g", 9) if kind == "double" else C("g")
    # filtering before the aggregate leaves most rows out of the shuffle
    top = gains.withColumn("g", g).filter("g > 0").groupBy("id").agg(F.max(F.struct("g", (-C("comm")).alias("minus"))).alias("b"))
    return top.select("id", (-C("b.minus")).alias("comm"), C("b.g").alias("g"))


def _m2(arcs: DataFrame) -> Column:
    value = arcs.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    return F.lit(value)


def best_moves(arcs: DataFrame, vertices: DataFrame, labels: DataFrame, who: DataFrame | None = None, m2: Column | None = None) -> DataFrame:
    return best_of(candidate_gains(arcs, vertices, labels, _m2(arcs) if m2 is None else m2, who))


def apply_moves(labels: DataFrame, moves: DataFrame) -> DataFrame:
    new = moves.select("id", C("comm").alias("new"))
    return labels.select("id", "comm").join(new, "id", "left").select("id", F.coalesce("new", "comm").alias("comm"))


def by_bucket(arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(vertices with their buckets, arcs with their sources' buckets, the buckets that have vertices with arcs), written once for a level."""
    vertices = materialize(degree_buckets(arcs, nodes), "buckets")
    dealt = materialize(arcs.join(small(vertices.select(C("id").alias("src"), "bucket")), "src").select("src", "dst", "w", "bucket"), "bucket-arcs", by="bucket")
    return vertices, dealt, [r["bucket"] for r in vertices.filter("bucket > 0").select("bucket").distinct().orderBy("bucket").collect()]


def bucket_pass(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, subset: DataFrame | None = None, tables: tuple[DataFrame, DataFrame, list[int]] | None = None, m2: Column | None = None) -> DataFrame:
    """One pass over the buckets: each moves against the labels that the one before left.  tables: by_bucket(arcs, nodes), m2: their total, if at hand."""
    vertices, dealt, present = by_bucket(arcs, nodes) if tables is None else tables
    m2 = _m2(arcs) if m2 is None else m2
    for b in present:
        moves = best_moves(dealt.filter(C("bucket") == b), vertices, labels, subset, m2)
        labels = materialize(apply_moves(labels, moves), "labels")
    return labels


def synchronous_sweeps(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, sweeps: int) -> DataFrame:
    """All vertices move at once, some times over; without buckets this may swing between partitions."""
    vertices = materialize(degree_buckets(arcs, nodes), "buckets")
    m2 = _m2(arcs)
    for _ in range(sweeps):
        labels = materialize(apply_moves(labels, best_moves(arcs, vertices, labels, None, m2)), "labels")
    return labels


def quality_parts(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (m2, inside, squares): modularity is (m2 inside - squares) / m2^2."""
    both = graph.with_label(graph.with_label(arcs, labels, "src", "cs"), labels, "dst", "cd")
    kind = "double" if dict(arcs.dtypes)["w"] in ("double", "float") else "decimal(38,0)"
    per = both.groupBy("cs").agg(F.sum("w").alias("tot"), F.sum(F.when(C("cs") == C("cd"), C("w")).otherwise(F.lit(0))).alias("inside"))
    zero = F.lit(0)
    return per.agg(F.coalesce(F.sum("tot"), zero).alias("m2"), F.coalesce(F.sum("inside"), zero).alias("inside"), F.coalesce(F.sum(C("tot").cast(kind) * C("tot").cast(kind)), zero).alias("squares"))


def modularity(arcs: DataFrame, labels: DataFrame) -> float:
    from fractions import Fraction

    m2, inside, squares = quality_parts(arcs, labels).first()
    if not m2:
        return 0.0
    if isinstance(m2, int):
        return float(Fraction(m2 * inside - int(squares), m2 * m2))
    return float(m2 * inside - squares) / (m2 * m2)


def renumber_communities(labels: DataFrame) -> DataFrame:
    """(comm, new_comm): communities that have members, numbered from 0 in ascending order."""
    return graph.dense_ids(labels.select("comm"), "comm", "new_comm")


def contract(arcs: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(arcs, nodes, dense labels): communities become vertices; arcs between two are summed, inner ones become the loop."""
    dense = labels.join(renumber_communities(labels), "comm").select("id", C("new_comm").alias("comm"))
    both = graph.with_label(graph.with_label(arcs, dense, "src", "s"), dense, "dst", "d")
    smaller = both.groupBy(C("s").alias("src"), C("d").alias("dst")).agg(F.sum("w").alias("w"))
    weights = nodes.join(dense, "id").groupBy(C("comm").alias("id")).agg(F.sum("node_w").alias("node_w"))
    return smaller, weights, dense


def community_arcs(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, w): every arc between its renumbered communities, not yet summed."""
    dense = labels.join(renumber_communities(labels), "comm").select("id", C("new_comm").alias("comm"))
    both = graph.with_label(graph.with_label(arcs, dense, "src", "s"), dense, "dst", "d")
    return both.select(C("s").alias("src"), C("d").alias("dst"), "w")


def compose(labels: DataFrame, upper: DataFrame) -> DataFrame:
    """Labels of vertices through the labels of their communities one level up."""
    up = upper.select(C("id").alias("comm"), C("comm").alias("up"))
    return labels.join(up, "comm").select("id", C("up").alias("comm"))
