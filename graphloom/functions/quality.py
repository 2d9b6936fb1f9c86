"""Ten partition-quality criteria: the score of a partition and the gain of a single move.

A criterion is a pair of Column expressions over aggregates, so scores and gains are plain projections that Catalyst
plans after one aggregation.  A new criterion is an entry of CRITERIA.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.operators import graph

C = F.col


def _d(name: str) -> Column:
    return C(name).cast("double")


def _where(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0))


@dataclass(frozen=True)
class Criterion:
    """score: aggregate over communities (in_w, tot_w, cw = vertices, m2, n, mx, extra), not yet divided by scale.
    scale: what the sum is divided by, from m2, n, mx.  gain: ranking value of a move into a community that the
    vertex has left (in_w, tot_w, cw) for a vertex (dnc, k, s, u)."""

    id: int
    name: str
    score: Callable[[dict], Column]
    scale: Callable[[], Column]
    gain: Callable[[dict], Column]
    prepare: str | None = None


def _over(a: Column, b: Column) -> Column:
    """a / b, 0 where that is undefined."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _owzad_gain(p: dict) -> Column:
    return _d("dnc") - F.lit(p["alpha"]) * _d("u") * _d("cw") * C("mx")


def _ratio_gain(own: Column, size: Column, after: Column, empty_minus: float = 0.0) -> Column:
    """Change of inner weight per size when the vertex joins; the first member starts the community."""
    start = _over(F.lit(2.0) * _d("dnc") + _d("s"), after) - F.lit(empty_minus)
    grown = (own + F.lit(2.0) * _d("dnc") + _d("s")) / (size + after) - own / size
    return F.when(size == 0, start).otherwise(grown)


_N2MX = lambda: C("n") * C("n") * C("mx")
_W = lambda: _d("cw")
_IN = lambda: _d("in_w")
_TOT = lambda: _d("tot_w")

CRITERIA: dict[int, Criterion] = {
    c.id: c
    for c in (
        Criterion(0, "modularity", lambda p: _where(_TOT() > 0, _IN() - _TOT() * _TOT() / C("m2")), lambda: C("m2"), lambda p: _d("dnc") - _over(_TOT() * _d("k"), C("m2"))),
        Criterion(1, "zahn", lambda p: _where(_W() > 0, F.lit(2.0) * _IN() - C("mx") * _W() * _W()) + F.first(_N2MX() - C("m2")), _N2MX, lambda p: F.lit(2.0) * _d("dnc") - _d("u") * _W() * C("mx")),
        Criterion(2, "owzad", lambda p: _where(_W() > 0, _IN() - F.lit(p["alpha"]) * C("mx") * _W() * _W()) + F.first(F.lit(p["alpha"]) * (_N2MX() - C("m2"))), _N2MX, _owzad_gain),
        Criterion(3, "goldberg", lambda p: _where(_W() > 0, _IN() / (F.lit(2.0) * _W())), lambda: C("n") * C("mx"), lambda p: _goldberg_gain()),
        Criterion(4, "condora", lambda p: _where(F.lit(True), _IN()) + F.first(C("extra")), lambda: C("n") * C("n"), lambda p: _d("dnc"), "condora"),
        Criterion(5, "devind", lambda p: _where(_W() > 0, _IN() - F.lit(2.0) * _TOT() * _W() / C("n")) + F.first(C("m2") / (C("n") * C("n"))) * _where(F.lit(True), _W() * _W()), lambda: C("m2"),
                  lambda p: _d("dnc") - (_TOT() * _d("u") + _d("k") * _W()) / C("n") + C("m2") * _d("u") * _W() / (C("n") * C("n"))),
        Criterion(6, "devuni", lambda p: _where(F.lit(True), _IN()) - F.first(C("m2") / (C("n") * C("n"))) * _where(F.lit(True), _W() * _W()), lambda: C("m2"),
                  lambda p: _d("dnc") - C("m2") * _d("u") * _W() / (C("n") * C("n"))),
        Criterion(7, "dp", lambda p: _where(_W() > 0, F.lit(2.0) * _IN() / _W()) - F.first(C("extra")) - _where(_W() > 0, F.lit(1.0)), _N2MX, lambda p: _ratio_gain(_IN(), _W(), _d("u"), 0.5), "dp"),
        Criterion(8, "shimalik", lambda p: _where(_TOT() > 0, _IN() / _TOT()) - _where(_W() > 0, F.lit(1.0)), lambda: C("n"),
                  lambda p: F.when(C("kappa") < F.lit(p["kappa_min"]), F.lit(0.0)).otherwise(_ratio_gain(_IN(), _TOT(), _d("k"), 1.0))),
        Criterion(9, "balmod", lambda p: _where(_W() > 0, F.lit(2.0) * _IN() - _over(_TOT() * _TOT(), C("m2")) - C("mx") * _W() * _W() + _balance(_W() * C("n") * C("mx") - _TOT(), C("n") * _W() * C("mx") - _TOT())), _N2MX,
                  lambda p: F.lit(2.0) * _d("dnc") - _over(_d("k") * _TOT(), C("m2")) - _d("u") * _W() * C("mx") + _balance(C("n") * _d("u") * C("mx") - _d("k"), C("n") * _W() * C("mx") - _TOT())),
    )
}


def _balance(a: Column, b: Column) -> Column:
    rest = _N2MX() - C("m2")
    return F.when(rest == 0, F.lit(0.0)).otherwise(a * b / rest)


def _goldberg_gain() -> Column:
    start = (F.lit(2.0) * _d("dnc") + _d("s")) / (F.lit(2.0) * _d("u"))
    grown = (_IN() + F.lit(2.0) * _d("dnc") + _d("s")) / (F.lit(2.0) * (_W() + _d("u"))) - _IN() / (F.lit(2.0) * _W())
    return F.when(_W() == 0, start).otherwise(grown)


NAMES = {c.name: c for c in CRITERIA.values()}


def criterion(which: int | str) -> Criterion:
    """By id or name; an unknown id is modularity."""
    if isinstance(which, str):
        return NAMES[which]
    return CRITERIA.get(which, CRITERIA[0])


def parameters(alpha: float = 0.5, kappa_min: int = 1) -> dict:
    """alpha outside (0, 1) is 0.5; kappa_min is at least 1."""
    return {"alpha": alpha if 0 < alpha < 1 else 0.5, "kappa_min": max(1, kappa_min)}


# reweighting


def reweight_condora(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w, extra): arcs with loops added and weights 2 aux - tmp; extra = tmp - aux."""
    full = graph.add_self_loops(arcs, nodes)
    d = graph.degrees(full, nodes).select("id", _d("degree").alias("d"), _d("loop_w").alias("s"))
    both = full.join(d.select(C("id").alias("src"), C("d").alias("di"), C("s").alias("si")), "src").join(d.select(C("id").alias("dst"), C("d").alias("dj"), C("s").alias("sj")), "dst")
    aux = F.lit(2.0) * _d("w") / (C("di") + C("dj"))
    tmp = C("si") / (F.lit(2.0) * C("di")) + C("sj") / (F.lit(2.0) * C("dj"))
    return both.select("src", "dst", (F.lit(2.0) * aux - tmp).alias("w"), (tmp - aux).alias("extra"))


def reweight_dp(arcs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, w, extra): weights 2 A / (d_i + d_j); extra is their square."""
    d = graph.degrees(arcs, nodes).select("id", _d("degree").alias("d"))
    both = arcs.join(d.select(C("id").alias("src"), C("d").alias("di")), "src").join(d.select(C("id").alias("dst"), C("d").alias("dj")), "dst")
    w = F.lit(2.0) * _d("w") / (C("di") + C("dj"))
    return both.select("src", "dst", w.alias("w"), (w * w).alias("extra"))


def prepared(c: Criterion, arcs: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arcs, one row of m2, n, mx, extra) as the criterion sees the graph; mx is that of the weights before."""
    mx = arcs.agg(F.coalesce(F.max("w"), F.lit(1)).cast("double").alias("mx"))
    if c.prepare:
        again = (reweight_condora if c.prepare == "condora" else reweight_dp)(arcs, nodes)
        sums = again.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("m2"), F.coalesce(F.sum("extra"), F.lit(0.0)).alias("extra"))
        arcs = again.select("src", "dst", "w")
    else:
        sums = arcs.agg(F.coalesce(F.sum("w"), F.lit(0)).cast("double").alias("m2"), F.lit(0.0).alias("extra"))
    n = nodes.agg(F.sum("node_w").cast("double").alias("n"))
    # three aggregates of one row each
    return arcs, sums.crossJoin(F.broadcast(mx)).crossJoin(F.broadcast(n))


def score(which: int | str, arcs: DataFrame, nodes: DataFrame, labels: DataFrame, digits: int | None = 9, sums: DataFrame | None = None, **options) -> DataFrame:
    """One row: criterion and its value q, rounded to `digits`; 0 where it is undefined (no arcs).

    sums: given if the arcs are prepared ones, or contracted from such.
    """
    c = criterion(which)
    arcs, sums = prepared(c, arcs, nodes) if sums is None else (arcs, sums)
    stats = graph.community_stats(arcs, nodes, labels).withColumnRenamed("node_w", "cw").crossJoin(F.broadcast(sums))
    got = stats.agg(c.score(parameters(**options)).alias("total"), F.first(c.scale()).alias("scale"))
    q = F.when(F.coalesce(C("scale"), F.lit(0.0)) == 0, F.lit(0.0)).otherwise(C("total") / C("scale"))
    return got.select(F.lit(c.name).alias("criterion"), (q if digits is None else F.round(q, digits)).alias("q"))


def gains(which: int | str, arcs: DataFrame, nodes: DataFrame, labels: DataFrame, digits: int | None = 9, sums: DataFrame | None = None, who: DataFrame | None = None, near: DataFrame | None = None, **options) -> DataFrame:
    """(id, comm, gain): for each vertex and adjacent community, its own included, with the vertex taken out first.

    who: vertices (id) to which this is restricted; near: the arcs that start from them, if at hand.
    """
    c = criterion(which)
    arcs, sums = prepared(c, arcs, nodes) if sums is None else (arcs, sums)
    stats = graph.community_stats(arcs, nodes, labels)
    d = graph.degrees(arcs, nodes).select("id", C("weighted_degree").alias("k"), C("loop_w").alias("s"))
    mine, used = labels, arcs if near is None else near
    if who is not None:
        mine = labels.join(who.select("id"), "id", "left_semi")
        used = used.join(who.select(C("id").alias("src")), "src", "left_semi") if near is None else used
    vertex = d.join(nodes.select("id", C("node_w").alias("u")), "id").join(mine.select("id", C("comm").alias("own")), "id")
    weights = graph.with_label(used.filter("src <> dst"), labels, "dst", "comm").select(C("src").alias("id"), "comm", "w")
    weights = weights.unionByName(mine.select("id", "comm", F.lit(0).cast(dict(arcs.dtypes)["w"]).alias("w"))).groupBy("id", "comm").agg(F.sum("w").alias("dnc"))
    rows = weights.join(vertex, "id").join(stats, "comm").crossJoin(F.broadcast(sums)).crossJoin(F.broadcast(stats.agg(F.count("*").alias("kappa"))))
    sizes = stats.select(C("comm").alias("own"), C("size").alias("own_size"))
    rows = rows.join(sizes, "own")
    own, alone = C("comm") == C("own"), C("own_size") == 1
    # a vertex that was alone leaves an empty community
    without = lambda value, part: F.when(own & alone, value - value).when(own, value - part).otherwise(value)
    rows = rows.select(
        "id", "comm", "own", "size", "own_size", "dnc", "k", "s", "u", "m2", "n", "mx", "extra",
        (C("kappa") - alone.cast("int")).alias("kappa"),
        without(C("in_w"), F.lit(2) * C("dnc") + C("s")).alias("in_w"),
        without(C("tot_w"), C("k")).alias("tot_w"),
        without(C("node_w"), C("u")).alias("cw"),
    )
    gain = c.gain(parameters(**options))
    return rows.select("id", "comm", (gain if digits is None else F.round(gain, digits)).alias("gain"), "own", "size", "own_size")


def best_moves(which: int | str, arcs: DataFrame, nodes: DataFrame, labels: DataFrame, sums: DataFrame, who: DataFrame, near: DataFrame | None = None, **options) -> DataFrame:
    """(id, comm): for the vertices in `who`, the community with the largest gain over their own, the lower id first among equals."""
    rows = gains(which, arcs, nodes, labels, None, sums, who, near, **options)
    stay = F.max(F.when(C("comm") == C("own"), C("gain"))).over(Window.partitionBy("id"))
    other = rows.withColumn("stay", stay).filter((C("comm") != C("own")) & ((C("comm") < C("own")) | (C("size") > 1) | (C("own_size") > 1)))
    net = other.withColumn("net", F.round(C("gain") - C("stay"), 9)).filter("net > 0")
    return net.groupBy("id").agg(F.max(F.struct("net", (-C("comm")).alias("minus"))).alias("b")).select("id", (-C("b.minus")).alias("comm"))


#: ΔQ of a move = factor * (gain of the new community - gain of the old one).
def move_factor(which: int | str) -> Callable[[float, float, float], float]:
    """(m2, n, mx) -> the factor between a difference of gains and the change of the score."""
    i = criterion(which).id
    if i in (0, 5, 6):
        return lambda m2, n, mx: 2 / m2
    if i in (1, 2, 7, 9):
        return lambda m2, n, mx: 2 / (n * n * mx)
    if i == 3:
        return lambda m2, n, mx: 1 / (n * mx)
    if i == 4:
        return lambda m2, n, mx: 2 / (n * n)
    return lambda m2, n, mx: 1 / n
