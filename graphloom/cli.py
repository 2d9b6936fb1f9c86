"""Command line: convert, detect, steps, matrix.  `python -m graphloom.cli <command> -h` lists the options."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from graphloom.functions import quality
from graphloom.operators import graph, hierarchy
from graphloom.plans import run
from graphloom.plans.metrics import Timers
from graphloom.plans.store import materialize
from graphloom.sources import files


def convert(spark: SparkSession, source: str, target: str, weighted: bool = False, relabel: str | None = None) -> None:
    """Text edges to a Parquet graph: cleaned, both directions; with `relabel`, isolated vertices go and the map is written there."""
    arcs = graph.arcs_of(files.read_edges(spark, source, weighted), weighted)
    if relabel:
        mapping = materialize(graph.renumber_map(arcs), "map")
        files.write_relabel_map(mapping, relabel)
        arcs = graph.renumber(arcs, mapping)
    arcs = materialize(arcs, "arcs")
    files.write_parquet_graph(arcs, graph.nodes_of(arcs), target)


def detect(spark: SparkSession, source: str, target: str, criterion: int = 0, min_gain: float = run.MIN_GAIN, alpha: float = 0.5, kappa_min: int = 1, start: str | None = None) -> run.Result:
    """Communities of a Parquet graph, from a start partition if there is one; hierarchy, labels and cluster sizes go under target."""
    arcs, nodes = files.read_parquet_graph(spark, source)
    labels = files.read_partition(spark, start, nodes) if start else None
    got = run.detect(arcs, nodes, labels, min_gain=min_gain, criterion=criterion, alpha=alpha, kappa_min=kappa_min)
    files.write_hierarchy(got.hierarchy, f"{target}/hierarchy")
    files.write_partition(got.labels, f"{target}/labels")
    files.write_cluster_sizes(got.labels, f"{target}/sizes")
    return got


def steps(
    spark: SparkSession, source: str, target: str, last: int, del_prefix: str | None, add_prefix: str | None, mode: str = "delta", weighted: bool = False,
    min_gain: float = run.MIN_GAIN, criterion: int = 0, alpha: float = 0.5, kappa_min: int = 1, start: str | None = None,
) -> list[run.Step]:
    """Static run, then steps 0 to `last` of changes, under a criterion.

    Under target go the last labels and members, the report and the times of its parts; and after the static run (number 0) and
    each half step (1, 2, ...) hierarchy/step=<number>, sizes/step=<number> and members/step=<number>.  A start partition begins the static run.
    """
    arcs, nodes = files.read_parquet_graph(spark, source)
    changes = materialize(files.read_changes(spark, del_prefix, add_prefix, last, weighted), "changes")
    options = {"min_gain": min_gain, "criterion": criterion, "alpha": alpha, "kappa_min": kappa_min}

    def write(report: run.Step, labels: DataFrame) -> None:
        if report.hierarchy is not None:  # else that of the half step before still holds
            files.write_hierarchy(report.hierarchy, f"{target}/hierarchy", report.number)
        files.write_cluster_sizes(labels, f"{target}/sizes/step={report.number}")
        files.write_members(labels, f"{target}/members/step={report.number}")

    timers, first = Timers(), []
    labels = files.read_partition(spark, start, nodes) if start else None
    if labels is not None:
        got = run.detect(arcs, nodes, labels, **options)
        labels, n = got.labels, nodes.count()
        first = [run.Step(-1, "start", n, arcs.count(), n, got.quality, len(got.metrics), 0.0, 0.0, got.hierarchy)]
        write(first[0], labels)
    *_, labels, reports = run.run_steps(arcs, nodes, changes, last, mode, weighted, labels, timers, write, **options)
    files.write_partition(labels, f"{target}/labels")
    files.write_members(labels, f"{target}/members/last")
    files.write_metrics(run.report_frame(spark, first + reports, mode), f"{target}/report")
    files.write_metrics(timers.frame(spark), f"{target}/times")
    return first + reports


def show_level(spark: SparkSession, source: str, levels: DataFrame, level: int) -> DataFrame:
    """(id, neighbours): the graph on which a level (from 1) of a run worked."""
    arcs, nodes = files.read_parquet_graph(spark, source)
    return graph.adjacency_lists(run.level_graph(arcs, nodes, levels, level))


def matrix(spark: SparkSession, source: str, level: int | None = None, dense: bool = False, pairs: bool = True) -> DataFrame:
    """Nodes by level of a hierarchy; with a level, co-membership there (level -2: the last but one).

    As pairs, as all pairs with 0 or 1 (dense), or as each vertex with its community, the form that grows with the vertices only.
    """
    levels = files.read_hierarchy(spark, source)
    if level is None or level == -1:
        return hierarchy.level_stats(levels)
    labels = hierarchy.flatten(levels, hierarchy.count_levels(levels) - 1 if level == -2 else level)
    if dense:
        return hierarchy.comembership_matrix(labels)
    if pairs:
        return hierarchy.comembership_pairs(labels)
    return labels


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("-i", required=True, metavar="TEXT")
    c.add_argument("-o", required=True, metavar="GRAPH")
    c.add_argument("-w", action="store_true", help="read weights")
    c.add_argument("-r", metavar="MAP", help="renumber and write the map")
    for name in ("detect", "steps"):
        d = sub.add_parser(name)
        d.add_argument("graph")
        d.add_argument("-o", required=True, metavar="FOLDER")
        d.add_argument("-e", type=float, default=run.MIN_GAIN, help="least gain of a pass")
        d.add_argument("-q", type=int, default=0, help="criterion: " + ", ".join(f"{i} {c.name}" for i, c in quality.CRITERIA.items()))
        d.add_argument("-c", type=float, default=0.5, help="alpha of criterion 2")
        d.add_argument("-k", type=int, default=1, help="kappa_min of criterion 8")
        d.add_argument("-p", metavar="PARTITION", help="start partition")
        if name == "detect":
            d.add_argument("-l", type=int, metavar="LEVEL", help="print the graph of this level (from 1)")
        else:
            d.add_argument("-a", type=int, required=True, metavar="LAST", help="last step")
            d.add_argument("-x", metavar="PREFIX", help="files of deletions")
            d.add_argument("-b", metavar="PREFIX", help="files of additions")
            d.add_argument("-w", action="store_true", help="changes have weights")
            d.add_argument("-m", choices=run.MODES, default="delta")
    m = sub.add_parser("matrix")
    m.add_argument("hierarchy")
    m.add_argument("-l", type=int, default=-1, help="level; -1: nodes by level, -2: the last but one")
    m.add_argument("-d", action="store_true", help="all pairs with 0 or 1")
    m.add_argument("-j", action="store_true", help="all joint pairs, instead of each vertex with its community")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "convert":
        convert(spark, a.i, a.o, a.w, a.r)
    elif a.command == "detect":
        got = detect(spark, a.graph, a.o, a.q, a.e, a.c, a.k, a.p)
        for row in got.metrics:
            print(row)
        if a.l:
            for v in show_level(spark, a.graph, got.hierarchy, a.l).orderBy("id").toLocalIterator():
                print(f"{v['id']}:", *[f"({x['dst']} {x['w']:g})" for x in v["neighbours"]])
    elif a.command == "steps":
        steps(spark, a.graph, a.o, a.a, a.x, a.b, a.m, a.w, a.e, a.q, a.c, a.k, a.p)
    else:
        rows = matrix(spark, a.hierarchy, a.l, a.d, a.j)
        print(*rows.columns)
        for row in rows.orderBy(*rows.columns).toLocalIterator():
            print(*row)


if __name__ == "__main__":
    main()
