"""Edge changes, seeding of new vertices, and delta-screening.

Changes are undirected rows (src, dst[, w]).  Screening gives the vertices worth re-evaluating after a change:
marked ones with their neighbours, and the members of flagged communities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.operators import graph, louvain

C = F.col


def apply_adds(arcs: DataFrame, adds: DataFrame, weighted: bool = False) -> DataFrame:
    """Arcs with both directions of the new edges; unweighted graphs are sets, weighted ones sum the copies."""
    new = graph.symmetrise(graph.with_weight(adds)).select("src", "dst", C("w").cast(dict(arcs.dtypes)["w"]).alias("w"))
    both = arcs.select("src", "dst", "w").unionByName(new)
    return graph.clean_weighted(both) if weighted else both.select("src", "dst").distinct().withColumn("w", F.lit(1).cast(dict(arcs.dtypes)["w"]))


def apply_deletes(arcs: DataFrame, dels: DataFrame, weighted: bool = False) -> DataFrame:
    """Arcs without the removed edges; in weighted graphs their weight is subtracted and what is not positive goes.  Edges that don't exist are skipped."""
    gone = graph.symmetrise(graph.with_weight(dels))
    if not weighted:
        return arcs.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")
    less = gone.groupBy("src", "dst").agg(F.sum("w").cast(dict(arcs.dtypes)["w"]).alias("less"))
    left = C("w") - F.coalesce("less", F.lit(0))
    return arcs.join(less, ["src", "dst"], "left").select("src", "dst", left.cast(dict(arcs.dtypes)["w"]).alias("w")).filter("w > 0")


def effective_deletes(arcs: DataFrame, dels: DataFrame) -> DataFrame:
    """(src, dst) with src <= dst: removed edges that the graph had."""
    canonical = dels.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst")).distinct()
    return canonical.join(arcs.select("src", "dst"), ["src", "dst"], "left_semi")


def all_vertices(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes up to the largest id that an arc has, with those known before; arcs and nodes are materialized."""
    top, old = arcs.agg(F.max(F.greatest("src", "dst"))).first()[0], nodes.agg(F.max("id")).first()[0]
    more = graph.vertex_range(arcs.sparkSession, -1 if old is None else old, -1 if top is None else top)
    return nodes.select("id", "node_w").unionByName(more.filter(F.lit(old is None) | (C("id") > F.lit(old))).filter("id >= 0"))


def seed_new_vertices(arcs: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of all nodes: a new vertex with one arc, to an old one, joins its community; others get fresh ones in order of id."""
    new = nodes.select("id").join(labels, "id", "left_anti")
    ends = arcs.join(new.select(C("id").alias("src")), "src", "left_semi").groupBy(C("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("to"))
    old = labels.select(C("id").alias("to"), C("comm").alias("joined"))
    joins = ends.filter("n = 1").join(old, "to").select("id", C("joined").alias("comm"))
    fresh = new.join(joins, "id", "left_anti")
    top = labels.agg(F.coalesce(F.max("comm"), F.lit(-1)).alias("top"))
    numbered = graph.dense_ids(fresh, "id", "rank").crossJoin(F.broadcast(top)).select("id", (C("top") + 1 + C("rank")).alias("comm"))
    return labels.select("id", "comm").union(joins).union(numbered)


def changed_ends(changes: DataFrame) -> DataFrame:
    """(id, other) in both directions."""
    return graph.symmetrise(graph.with_weight(changes)).select(C("src").alias("id"), C("dst").alias("other"))


def screen_add_marks(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, adds: DataFrame, m2: Column | None = None) -> DataFrame:
    """(id, comm): sources of new edges that gain by a move into a community of a new neighbour, with the best one."""
    ends = changed_ends(adds)
    targets = graph.with_label(ends, labels, "other", "comm").select("id", "comm")
    own = labels.join(ends.select("id").distinct(), "id", "left_semi")
    allowed = targets.union(own.select("id", "comm")).distinct()
    vertices = graph.degrees(arcs, nodes).select("id", C("weighted_degree").alias("k"))
    m2 = louvain._m2(arcs) if m2 is None else m2
    gains = louvain.candidate_gains(arcs, vertices, labels, m2, ends.select("id").distinct(), allowed)
    return louvain.best_of(gains).select("id", "comm")


def screen_del_marks(labels: DataFrame, removed: DataFrame) -> DataFrame:
    """(id, comm): ends of removed edges inside a community, with it."""
    ends = changed_ends(removed)
    both = graph.with_label(graph.with_label(ends, labels, "id", "comm"), labels, "other", "other_comm")
    return both.filter("comm = other_comm").select("id", "comm").distinct()


def expand(arcs: DataFrame, marked: DataFrame) -> DataFrame:
    """Marked vertices and all their neighbours."""
    near = arcs.join(marked.select(C("id").alias("src")), "src", "left_semi").select(C("dst").alias("id"))
    return marked.select("id").union(near).distinct()


def finalize(arcs: DataFrame, labels: DataFrame, marks: DataFrame) -> DataFrame:
    """(id): marked vertices, their neighbours, and the members of the flagged communities."""
    members = labels.join(marks.select("comm").distinct(), "comm", "left_semi").select("id")
    return expand(arcs, marks.select("id").distinct()).union(members).distinct()


def screen_add(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, adds: DataFrame) -> DataFrame:
    return finalize(arcs, labels, screen_add_marks(arcs, nodes, labels, adds))


def screen_del(arcs: DataFrame, labels: DataFrame, removed: DataFrame) -> DataFrame:
    return finalize(arcs, labels, screen_del_marks(labels, removed))


def screen_endpoints(labels: DataFrame, adds: DataFrame) -> DataFrame:
    """The sequential rule for additions, in effect: ends of new edges between communities."""
    ends = changed_ends(adds)
    both = graph.with_label(graph.with_label(ends, labels, "id", "c"), labels, "other", "o")
    return both.filter("c <> o").select("id").distinct()


def screen_communities(arcs: DataFrame, labels: DataFrame, removed: DataFrame) -> DataFrame:
    """The sequential rule for deletions, for all ends: members of the communities and the ends' neighbours outside."""
    marks = screen_del_marks(labels, removed)
    members = labels.join(marks.select("comm").distinct(), "comm", "left_semi").select("id")
    ends = marks.select(C("id").alias("src"), C("comm").alias("c"))
    outside = graph.with_label(arcs.join(ends, "src"), labels, "dst", "d").filter("c <> d").select(C("dst").alias("id"))
    return members.union(outside).distinct()


def screen_everything(nodes: DataFrame) -> DataFrame:
    return nodes.select("id")


def r_percentage(screened: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row (r_size, n, r_pct)."""
    r, n = screened.agg(F.count("*").alias("r_size")), nodes.agg(F.count("*").alias("n"))
    return r.crossJoin(n).select("r_size", "n", F.round(F.lit(100.0) * C("r_size") / C("n"), 9).alias("r_pct"))
