"""Community detection and its upkeep over steps of changes.

A level runs as DataFrame jobs, one for each non-empty degree bucket.  Once a graph has at most `local_arcs` arcs, the
rest of the level loop runs on arrays in a single task (functions.local_louvain); the bound, also on vertices, is checked before.
If only the vertices are within the bound, a level under modularity runs on arrays dealt over tasks (plans.dealt_level).
Runs take any of the ten criteria; under others than modularity a pass that loses is undone.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.functions import local_louvain, quality
from graphloom.operators import dynamic, graph, louvain
from graphloom.operators.hierarchy import flatten
from graphloom.plans import dealt_level
from graphloom.plans.metrics import Timer, Timers
from graphloom.plans.store import materialize

C = F.col

#: Stop a level when a pass gains less (fixed value, the usual default).
MIN_GAIN = 0.001
#: Arcs, and vertices, that a single task may hold (about 40 bytes each).
LOCAL_ARCS = 2_000_000
MAX_PASSES = 100


@dataclass
class Result:
    """labels (id, comm); hierarchy (level, node, comm); metrics by level."""

    labels: DataFrame
    hierarchy: DataFrame
    metrics: list[dict] = field(default_factory=list)

    @property
    def quality(self) -> float:
        return self.metrics[-1]["quality"] if self.metrics else 0.0


_LOCAL = "kind int, level int, a long, b long, x double"


def _local_levels(spark: SparkSession, arcs: DataFrame, nodes: DataFrame, labels: DataFrame | None, subset: DataFrame | None, options: dict, changed: tuple[str, DataFrame] | None = None) -> tuple[DataFrame, list[dict]]:
    """(hierarchy, metrics) of a graph that fits one task; ids may be any integers.

    changed: ("add" or "del", edges) to screen first; metrics then hold r_size and screening_ms, and there are no levels if r_size is 0.
    """
    rows = arcs.select(F.lit(0).alias("kind"), C("src").alias("a"), C("dst").alias("b"), C("w").cast("double").alias("x"))
    rows = rows.unionByName(nodes.select(F.lit(1).alias("kind"), C("id").alias("a"), C("node_w").cast("long").alias("b"), F.lit(0.0).alias("x")))
    if labels is not None:
        rows = rows.unionByName(labels.select(F.lit(2).alias("kind"), C("id").alias("a"), C("comm").alias("b"), F.lit(0.0).alias("x")))
    if subset is not None:
        rows = rows.unionByName(subset.select(F.lit(3).alias("kind"), C("id").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0.0).alias("x")))
    if changed is not None:
        rows = rows.unionByName(changed[1].select(F.lit(4).alias("kind"), C("src").cast("long").alias("a"), C("dst").cast("long").alias("b"), F.lit(0.0).alias("x")))
    op = None if changed is None else changed[0]
    warm, screened, whole = labels is not None, subset is not None, dict(arcs.dtypes)["w"] not in ("double", "float")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for b in batches]
        kind, a, b, x = (np.concatenate([g[i] for g in got]) if got else np.zeros(0) for i in range(4))
        order = np.argsort(a[kind == 1])
        ids, node_w = a[kind == 1][order], b[kind == 1][order]
        at = lambda v: np.searchsorted(ids, v)
        mine = kind == 0
        w = x[mine].astype(np.int64) if whole else x[mine]
        g = local_louvain.Graph(len(ids), at(a[mine]), at(b[mine]), w, node_w)
        start = None
        if warm:
            start = np.arange(len(ids))
            given, comm = at(a[kind == 2]), b[kind == 2]
            # communities keep their order, so ties go the same way
            start[given] = np.unique(comm, return_inverse=True)[1]
        chosen = None
        if screened:
            chosen = np.zeros(len(ids), bool)
            chosen[at(a[kind == 3])] = True
        r_size, began = len(ids), time.perf_counter()
        if op is not None:
            v, t = at(a[kind == 4]), at(b[kind == 4])
            chosen = local_louvain.screen(g, start, np.concatenate([v, t]), np.concatenate([t, v]), op == "add")
            r_size = int(chosen.sum())
        screening_ms = 1000 * (time.perf_counter() - began) if op is not None else 0.0
        levels, metrics = local_louvain.louvain(g, start, chosen, **options) if r_size or op is None else ([], [{"level": -1, "nodes": len(ids), "arcs": len(g.src), "passes": 0, "quality": g.quality(start)}])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (np.int32(-1), np.int32(0), np.int64(r_size), np.int64(0), screening_ms)], names=["kind", "level", "a", "b", "x"])
        for i, dense in enumerate(levels):
            node = ids if i == 0 else np.arange(len(dense))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(dense), np.int32)), pa.array(np.full(len(dense), i, np.int32)), pa.array(node.astype(np.int64)), pa.array(dense.astype(np.int64)), pa.array(np.zeros(len(dense)))], names=["kind", "level", "a", "b", "x"])
        for m in metrics:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (np.int32(m["passes"] + 1), np.int32(m["level"]), np.int64(m["nodes"]), np.int64(m["arcs"]), float(m["quality"]))], names=["kind", "level", "a", "b", "x"])

    out = materialize(rows.coalesce(1).mapInArrow(run, _LOCAL), "levels")
    said = out.filter("kind <> 0").orderBy("level").collect()
    first = next(r for r in said if r["kind"] == -1)
    metrics = [{"level": r["level"], "nodes": r["a"], "arcs": r["b"], "passes": r["kind"] - 1, "quality": r["x"], "r_size": first["a"], "screening_ms": first["x"]} for r in said if r["kind"] > 0]
    return out.filter("kind = 0").select("level", C("a").alias("node"), C("b").alias("comm")), metrics


def _flat(levels: DataFrame, metrics: list[dict]) -> DataFrame:
    """Labels of the original vertices through all levels."""
    flat = None
    for m in metrics:
        part = levels.filter(C("level") == m["level"]).select(C("node").alias("id"), "comm")
        flat = part if flat is None else louvain.compose(flat, part)
    return flat


@dataclass(frozen=True)
class Rules:
    """How a level is scored and moved: exact modularity, or a criterion on its prepared graph."""

    criterion: int = 0
    alpha: float = 0.5
    kappa_min: int = 1
    sums: DataFrame | None = None

    def on_arrays(self) -> local_louvain.Rule | None:
        if self.sums is None:
            return None
        s, p = self.sums.first(), quality.parameters(self.alpha, self.kappa_min)
        return local_louvain.Rule(quality.criterion(self.criterion).id, s["m2"], s["n"], s["mx"], s["extra"], p["alpha"], p["kappa_min"])

    def score(self, arcs: DataFrame, nodes: DataFrame, labels: DataFrame) -> float:
        if self.sums is None:
            return louvain.modularity(arcs, labels)
        return quality.score(self.criterion, arcs, nodes, labels, None, self.sums, alpha=self.alpha, kappa_min=self.kappa_min).first()["q"]

    def one_pass(self, arcs: DataFrame, nodes: DataFrame, labels: DataFrame, subset: DataFrame | None, tables: tuple, m2) -> DataFrame:
        if self.sums is None:
            return louvain.bucket_pass(arcs, nodes, labels, subset, tables, m2)
        vertices, dealt, present = tables
        for b in present:
            who, near = vertices.filter(C("bucket") == b).select("id"), dealt.filter(C("bucket") == b)
            if subset is not None:
                who = who.join(subset.select("id"), "id", "left_semi")
                near = near.join(subset.select(C("id").alias("src")), "src", "left_semi")
            moves = quality.best_moves(self.criterion, arcs, nodes, labels, self.sums, who, near, alpha=self.alpha, kappa_min=self.kappa_min)
            labels = materialize(louvain.apply_moves(labels, moves), "labels")
        return labels


def run_level(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, subset: DataFrame | None = None, min_gain: float = MIN_GAIN, max_passes: int = MAX_PASSES, on_bad_pass: str = "keep", rules: Rules = Rules()) -> tuple[DataFrame, bool, int, float]:
    """(labels, whether a pass gained, passes, quality): passes over the buckets as DataFrame jobs."""
    tables, m2 = louvain.by_bucket(arcs, nodes), louvain._m2(arcs)
    q, improved, passes = rules.score(arcs, nodes, labels), False, 0
    while passes < max_passes:
        new = rules.one_pass(arcs, nodes, labels, subset, tables, m2)
        passes += 1
        now = rules.score(arcs, nodes, new)
        # without a move nothing is gained, so only a bound of 0 needs to look
        moved = min_gain > 0 or bool(new.join(labels.select("id", C("comm").alias("was")), "id").filter("comm <> was").head(1))
        if now < q and on_bad_pass == "revert":
            break
        improved |= now > q
        stop = now - q < min_gain or not moved
        labels, q = new, now
        if stop:
            break
    return labels, improved, passes, q


def detect(arcs: DataFrame, nodes: DataFrame, labels: DataFrame | None = None, subset: DataFrame | None = None, min_gain: float = MIN_GAIN, max_passes: int = MAX_PASSES, max_levels: int = 100, local_arcs: int = LOCAL_ARCS, on_bad_pass: str | None = None, criterion: int | str = 0, alpha: float = 0.5, kappa_min: int = 1) -> Result:
    """Level loop under a criterion.  With initial labels the first level is contracted even without a gain; a subset restricts level 0 only.

    Under a criterion other than modularity the graph is prepared (loops, new weights) once, on the original vertices; its totals hold
    on all levels.  on_bad_pass: "keep" or "revert" what a losing pass moved; by default modularity keeps, the others revert.
    """
    spark, c = arcs.sparkSession, quality.criterion(criterion)
    rules = Rules(c.id, alpha, kappa_min)
    if c.id:
        arcs, sums = quality.prepared(c, arcs, nodes)
        arcs, rules = materialize(arcs, "arcs"), Rules(c.id, alpha, kappa_min, materialize(sums, "sums"))
    bad = on_bad_pass or ("revert" if c.id else "keep")
    options = {"min_gain": min_gain, "max_passes": max_passes, "on_bad_pass": bad}
    hierarchy, metrics, level, flat, warm = None, [], 0, None, labels is not None
    while level < max_levels:
        n_arcs, n_nodes = arcs.count(), nodes.count()
        if max(n_arcs, n_nodes) <= local_arcs:
            rest, more = _local_levels(spark, arcs, nodes, labels, subset, options | {"max_levels": max_levels - level, "rule": rules.on_arrays()})
            rest = rest.withColumn("level", C("level") + level)
            hierarchy = rest if hierarchy is None else hierarchy.unionByName(rest)
            metrics += [m | {"level": m["level"] + level} for m in more]
            for m in more:
                part = rest.filter(C("level") == m["level"] + level).select(C("node").alias("id"), "comm")
                flat = part if flat is None else louvain.compose(flat, part)
            break
        if c.id == 0 and n_nodes <= local_arcs:
            current, improved, passes, q = dealt_level.run_level(arcs, nodes, labels, subset, n_arcs, min_gain, max_passes, bad)
        else:
            current = louvain.identity_labels(nodes) if labels is None else labels
            current, improved, passes, q = run_level(arcs, nodes, materialize(current, "labels"), subset, min_gain, max_passes, bad, rules)
        smaller, weights, dense = louvain.contract(arcs, nodes, current)
        dense = materialize(dense, "dense")
        metrics.append({"level": level, "nodes": n_nodes, "arcs": n_arcs, "passes": passes, "quality": q})
        part = dense.select(F.lit(level).alias("level"), C("id").alias("node"), "comm")
        hierarchy = part if hierarchy is None else hierarchy.unionByName(part)
        flat = dense if flat is None else materialize(louvain.compose(flat, dense), "flat")
        if not improved and not (level == 0 and warm):
            break
        arcs, nodes, labels, subset = materialize(smaller, "arcs"), materialize(weights, "nodes"), None, None
        level += 1
    return Result(materialize(flat.select("id", "comm"), "communities"), hierarchy, metrics)


def detect_by(which: int | str, arcs: DataFrame, nodes: DataFrame, min_gain: float = MIN_GAIN, max_passes: int = MAX_PASSES, max_levels: int = 100, start: DataFrame | None = None, **options) -> Result:
    """detect under a criterion by id or name, from an initial partition if there is one; losing passes are undone."""
    return detect(arcs, nodes, start, None, min_gain, max_passes, max_levels, on_bad_pass="revert", criterion=which, **options)


def level_graph(arcs: DataFrame, nodes: DataFrame, hierarchy: DataFrame, level: int) -> DataFrame:
    """Arcs of the graph on which level `level` (from 1) of a run worked: the start graph, or that of the communities below."""
    if level <= 1:
        return arcs
    return louvain.contract(arcs, nodes, flatten(hierarchy, level - 1))[0]


MODES = ("delta", "full", "static")


@dataclass
class Step:
    """The report of a half step, with the hierarchy (level, node, comm) that it found; none if nothing was re-evaluated."""

    step: int
    op: str
    n: int
    arcs: int
    r_size: int
    quality: float
    levels: int
    ms: float
    screening_ms: float
    hierarchy: DataFrame | None = field(default=None, repr=False, compare=False)

    @property
    def r_pct(self) -> float:
        return 100.0 * self.r_size / self.n if self.n else 0.0

    @property
    def number(self) -> int:
        """0 for the start, then deletions and additions of the steps in turn."""
        return 0 if self.op == "start" else 2 * self.step + (1 if self.op == "del" else 2)


def _screened(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, changes: DataFrame, op: str, by_modularity: bool) -> DataFrame:
    """Vertices to re-evaluate: by the parallel rule under modularity; under other criteria by the sequential one, which asks for no gain."""
    if by_modularity:
        return dynamic.screen_del(arcs, labels, changes) if op == "del" else dynamic.screen_add(arcs, nodes, labels, changes)
    return dynamic.screen_communities(arcs, labels, changes) if op == "del" else dynamic.screen_endpoints(labels, changes)


def half_step(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, changes: DataFrame, op: str, mode: str = "delta", weighted: bool = False, step: int = 0, timers: Timers | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame, Step]:
    """(arcs, nodes, labels, report) after one batch of deletions ("del") or additions ("add").

    delta: warm start, only the screened vertices are re-evaluated at level 0.  full: warm start, all of them.  static: from singletons.
    options: those of detect, the criterion among them.
    """
    if mode not in MODES:
        raise ValueError(f"mode {mode!r} is none of {MODES}")
    part = timers or (lambda name: nullcontext())
    began = time.time()
    with part("apply changes"):
        if op == "del":
            effective = materialize(dynamic.effective_deletes(arcs, changes), "removed")
            arcs = materialize(dynamic.apply_deletes(arcs, changes, weighted), "arcs")
        else:
            effective = changes
            arcs = materialize(dynamic.apply_adds(arcs, changes, weighted), "arcs")
            nodes = materialize(dynamic.all_vertices(arcs, nodes), "nodes")
            labels = materialize(dynamic.seed_new_vertices(arcs, nodes, labels), "labels")
        n, n_arcs = nodes.count(), arcs.count()
    by_modularity = quality.criterion(options.get("criterion", 0)).id == 0
    screen = Timer()
    subset, r_size = None, n

    def report(q: float, levels: int, hierarchy: DataFrame | None, screening_ms: float) -> Step:
        return Step(step, op, n, n_arcs, r_size, q, levels, 1000 * (time.time() - began), screening_ms, hierarchy)

    if mode == "delta" and by_modularity and max(n, n_arcs) <= options.get("local_arcs", LOCAL_ARCS):
        # screened and re-evaluated in one task
        kept = {"min_gain": MIN_GAIN, "max_passes": MAX_PASSES} | {k: v for k, v in options.items() if k in ("min_gain", "max_passes", "max_levels", "on_bad_pass") and v is not None}
        with part("screen and detect"):
            levels, metrics = _local_levels(arcs.sparkSession, arcs, nodes, labels, None, kept, (op, effective))
            r_size = metrics[0]["r_size"]
            if r_size:
                labels = materialize(_flat(levels, metrics), "communities")
        return arcs, nodes, labels, report(metrics[-1]["quality"], len(metrics) if r_size else 0, levels if r_size else None, metrics[0]["screening_ms"])
    if mode == "delta":
        with screen, part("screen"):
            subset = materialize(_screened(arcs, nodes, labels, effective, op, by_modularity), "screened")
            r_size = subset.count()
    if r_size == 0:  # nothing to re-evaluate: the labels carry over
        with part("detect"):
            q = quality_of(arcs, nodes, labels, **options)
        return arcs, nodes, labels, report(q, 0, None, screen.ms)
    with part("detect"):
        got = detect(arcs, nodes, None if mode == "static" else labels, subset, **options)
    return arcs, nodes, got.labels, report(got.quality, len(got.metrics), got.hierarchy, screen.ms)


def quality_of(arcs: DataFrame, nodes: DataFrame, labels: DataFrame, criterion: int | str = 0, alpha: float = 0.5, kappa_min: int = 1, **_) -> float:
    """Score of a partition of the original vertices."""
    if quality.criterion(criterion).id == 0:
        return louvain.modularity(arcs, labels)
    return quality.score(criterion, arcs, nodes, labels, None, alpha=alpha, kappa_min=kappa_min).first()["q"]


def run_steps(
    arcs: DataFrame, nodes: DataFrame, changes: DataFrame, steps: int, mode: str = "delta", weighted: bool = False, labels: DataFrame | None = None,
    timers: Timers | None = None, on_step: Callable[[Step, DataFrame], None] | None = None, **options,
) -> tuple[DataFrame, DataFrame, DataFrame, list[Step]]:
    """Static run, then steps 0 to `steps` of changes (step, op, src, dst[, w]), deletions before additions; a missing batch is skipped.

    on_step(report, labels) is called after the static run and after every half step.
    """
    part, reports = timers or (lambda name: nullcontext()), []
    if labels is None:
        began = time.time()
        with part("static run"):
            first = detect(arcs, nodes, **options)
        labels, n = first.labels, nodes.count()
        reports.append(Step(-1, "start", n, arcs.count(), n, first.quality, len(first.metrics), 1000 * (time.time() - began), 0.0, first.hierarchy))
        if on_step:
            on_step(reports[-1], labels)
    present = {(r["step"], r["op"]) for r in changes.select("step", "op").distinct().collect()}  # one row for each batch
    for step in range(steps + 1):
        for op in ("del", "add"):
            if (step, op) not in present:
                continue
            batch = changes.filter((C("step") == step) & (C("op") == op))
            with part(f"step {step} {op}"):
                arcs, nodes, labels, report = half_step(arcs, nodes, labels, batch, op, mode, weighted, step, timers, **options)
            reports.append(report)
            if on_step:
                on_step(report, labels)
    return arcs, nodes, labels, reports


def report_frame(spark: SparkSession, reports: list[Step], mode: str) -> DataFrame:
    """Metrics of a run as a DataFrame."""
    rows = [(r.step, r.op, mode, r.n, r.arcs, r.r_size, round(r.r_pct, 9), round(r.quality, 9), r.levels, r.ms, r.screening_ms) for r in reports]
    return spark.createDataFrame(rows, "step int, op string, mode string, n long, arcs long, r_size long, r_pct double, quality double, levels int, ms double, screening_ms double")


def load_graph(edges: DataFrame, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """(arcs, nodes), materialized: cleaned, both directions, vertices 0 to the largest id."""
    arcs = materialize(graph.arcs_of(edges, weighted), "arcs")
    return arcs, materialize(graph.nodes_of(arcs), "nodes")
