"""Goldens on the toy graph, invariants, and the small cases that tables don't hold."""

from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from graphloom.functions import local_louvain, quality
from graphloom.operators import dynamic, graph, hierarchy, louvain
from graphloom.plans import run
from graphloom.plans.metrics import Timers
from graphloom.plans.store import materialize
from graphloom.sources import files, tables
from graphloom.streaming import changes as stream

P = {0: 0, 1: 0, 2: 0, 4: 0, 5: 5, 6: 5, 7: 5, 8: 5, 10: 10, 11: 10, 12: 10, 13: 10, 3: 3, 9: 9}
SCORES = {
    0: ("-29/324", "89/162"), 1: ("73/98", "87/98"), 2: ("73/196", "87/196"), 3: ("0", "2/7"), 4: ("1681/61740", "2047/30870"),
    5: ("-1/14", "505/882"), 6: ("-1/14", "559/882"), 7: ("-130583/1440600", "-12949/720300"), 8: ("-1", "-97/588"), 9: ("-2033/70560", "913/4410"),
}
STEPS = [("start", 14, "89/162"), ("del", 5, "69/128"), ("add", 4, "409/722"), ("del", 4, "259/512"), ("add", 3, "429/722")]


@pytest.fixture(scope="module")
def toy(spark):
    return run.load_graph(tables.toy_edges(spark))


def labels_frame(spark, labels):
    return spark.createDataFrame([(int(k), int(v)) for k, v in labels.items()], "id long, comm long")


def partition(labels):
    """Communities as a set of frozen sets."""
    out = {}
    for id_, comm in labels.select("id", "comm").collect():
        out.setdefault(comm, set()).add(id_)
    return {frozenset(v) for v in out.values()}


@pytest.mark.parametrize("which", range(10))
def test_scores_on_toy(spark, toy, which):
    single, blocks = (Fraction(x) for x in SCORES[which])
    assert quality.score(which, *toy, louvain.identity_labels(toy[1])).first()["q"] == pytest.approx(float(single), abs=1e-8)
    assert quality.score(which, *toy, labels_frame(spark, P)).first()["q"] == pytest.approx(float(blocks), abs=1e-8)


@pytest.mark.parametrize("which", range(10))
def test_gains_explain_scores(spark, toy, which):
    """A move changes the score by the factor times the difference of gains."""
    arcs, nodes = toy
    c = quality.criterion(which)
    _, sums = quality.prepared(c, arcs, nodes)
    s = sums.first()
    factor = quality.move_factor(which)(s["m2"], s["n"], s["mx"])
    before = quality.score(which, arcs, nodes, labels_frame(spark, P), digits=None).first()["q"]
    gains = {(r["id"], r["comm"]): r["gain"] for r in quality.gains(which, arcs, nodes, labels_frame(spark, P), digits=None).collect()}
    after = quality.score(which, arcs, nodes, labels_frame(spark, P | {4: 5}), digits=None).first()["q"]
    assert after - before == pytest.approx(factor * (gains[4, 5] - gains[4, 0]), abs=1e-9)


def test_parameters_are_guarded():
    assert quality.parameters(alpha=7) == {"alpha": 0.5, "kappa_min": 1}
    assert quality.criterion(99).name == "modularity"


@pytest.mark.parametrize("mode", run.MODES)
def test_toy_steps(spark, toy, mode):
    _, _, labels, reports = run.run_steps(*toy, tables.toy_changes(spark), 1, mode)
    for r, (op, screened, q) in zip(reports, STEPS, strict=True):
        assert r.op == op and r.quality == pytest.approx(float(Fraction(q)), abs=1e-9)
        if mode == "delta":
            assert r.r_size == screened
    assert {frozenset(x) for x in ({0, 1, 2, 4}, {5, 6, 7, 8}, {3, 9, 10}, {11, 12, 13}, {14, 15, 16})} == partition(labels)


def test_dataframe_and_array_levels_agree(toy):
    local, spread = run.detect(*toy), run.detect(*toy, local_arcs=0)
    assert partition(local.labels) == partition(spread.labels)
    assert [m["quality"] for m in local.metrics] == pytest.approx([m["quality"] for m in spread.metrics])
    assert [m["passes"] for m in local.metrics] == [m["passes"] for m in spread.metrics]


def test_contraction_keeps_weight_and_quality(spark, toy):
    arcs, nodes = toy
    labels = labels_frame(spark, P)
    smaller, weights, dense = louvain.contract(arcs, nodes, labels)
    assert smaller.agg({"w": "sum"}).first()[0] == arcs.agg({"w": "sum"}).first()[0]
    assert weights.agg({"node_w": "sum"}).first()[0] == 14
    assert louvain.modularity(smaller, louvain.identity_labels(weights)) == pytest.approx(louvain.modularity(arcs, labels))
    assert sorted(r["comm"] for r in dense.select("comm").distinct().collect()) == list(range(5))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 3)), min_size=1, max_size=30))
def test_arrays_reach_good_partitions(edges):
    """The array level loop on random weighted graphs with loops: quality never below singletons, labels total, contraction exact."""
    w = {}
    for a, b, x in edges:
        for s, d in {(a, b), (b, a)}:
            w[s, d] = w.get((s, d), 0) + x
    keys = np.array(list(w))
    g = local_louvain.Graph(13, keys[:, 0], keys[:, 1], np.array(list(w.values())))
    levels, metrics = local_louvain.louvain(g, on_bad_pass="revert")
    flat = np.arange(13)
    for level in levels:
        flat = level[flat]
    assert g.quality(flat) == pytest.approx(metrics[-1]["quality"])
    assert g.quality(flat) >= g.quality(np.arange(13)) - 1e-12


def test_exhaustive_optimum_of_a_component():
    """Two triangles joined by an edge: the level loop finds the best of all partitions."""
    edges = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    s = np.array([a for a, _ in edges] + [b for _, b in edges])
    d = np.array([b for _, b in edges] + [a for a, _ in edges])
    g = local_louvain.Graph(6, s, d, np.ones(14, np.int64))
    best = max(g.quality(np.array(p)) for p in product(range(4), repeat=6))
    _, metrics = local_louvain.louvain(g)
    assert metrics[-1]["quality"] == pytest.approx(best)


def test_bucket_bounds():
    degrees = np.array([0, 1, 4, 5, 8, 9, 16, 17, 32, 33, 84, 85, 319, 320])
    assert local_louvain.bucket_of(degrees).tolist() == [0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6, 7]


def test_ties_and_singletons():
    """Equal gains go to the lower community; of two single vertices only the higher one moves."""
    g = local_louvain.Graph(3, np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.ones(4, np.int64))
    labels = np.arange(3)
    v, c = local_louvain.best_moves(g, labels, np.arange(3), g.k.copy(), np.ones(3, np.int64))
    assert dict(zip(v.tolist(), c.tolist())) == {1: 0, 2: 1}


# small cases


def edges_frame(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, w double")


def test_loops_copies_and_gaps(spark):
    edges = edges_frame(spark, [(0, 0, 2), (1, 3, 1), (1, 3, 4)])
    weighted = graph.arcs_of(edges, True)
    assert {tuple(r) for r in weighted.collect()} == {(0, 0, 2.0), (1, 3, 5.0), (3, 1, 5.0)}
    assert {tuple(r) for r in graph.arcs_of(edges).collect()} == {(0, 0, 1), (1, 3, 1), (3, 1, 1)}
    nodes = graph.nodes_of(weighted)
    d = {r["id"]: (r["degree"], r["weighted_degree"], r["loop_w"]) for r in graph.degrees(weighted, nodes).collect()}
    assert d == {0: (1, 2.0, 2.0), 1: (1, 5.0, 0.0), 2: (0, 0.0, 0.0), 3: (1, 5.0, 0.0)}
    assert {tuple(r) for r in graph.renumber_map(weighted).collect()} == {(0, 0), (1, 1), (3, 2)}
    assert graph.is_symmetric(weighted) and not graph.is_symmetric(weighted.filter("src <> 3"))
    assert graph.drop_marked(spark.createDataFrame([(1,), (-1,)], "a long"), "a").count() == 1


def test_dense_ids_over_several_blocks(spark):
    ids = [5, 3_000_000, 7, 3_000_001, 2_000_000, 5]
    got = graph.dense_ids(spark.createDataFrame([(i,) for i in ids], "a long"), "a", "n").collect()
    assert {r["a"]: r["n"] for r in got} == {5: 0, 7: 1, 2_000_000: 2, 3_000_000: 3, 3_000_001: 4}


def test_changes_on_small_graphs(spark):
    arcs = materialize(graph.arcs_of(edges_frame(spark, [(0, 1, 1), (1, 2, 1)])), "arcs")
    nodes = graph.nodes_of(arcs)
    adds = spark.createDataFrame([(0, 2), (3, 0), (4, 0), (5, 6)], "src long, dst long")
    more = dynamic.apply_adds(arcs, adds)
    assert {(r["src"], r["dst"]) for r in more.collect()} >= {(0, 2), (2, 0), (0, 3), (5, 6)}
    back = dynamic.apply_deletes(more, adds)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in arcs.collect()}
    full = dynamic.all_vertices(more, nodes)
    seeded = {r["id"]: r["comm"] for r in dynamic.seed_new_vertices(more, full, labels_frame(spark, {0: 1, 1: 1, 2: 1})).collect()}
    # two new vertices on one old one join it; a new pair and gaps get fresh communities
    assert seeded == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 3}


def test_missing_and_cross_deletes(spark, toy):
    arcs, _ = toy
    dels = spark.createDataFrame([(0, 13), (2, 6)], "src long, dst long")
    removed = dynamic.effective_deletes(arcs, dels)
    assert [tuple(r) for r in removed.collect()] == [(2, 6)]
    # 2 and 6 are in different communities: nothing to re-evaluate
    assert dynamic.screen_del(arcs, labels_frame(spark, P), removed).count() == 0


def test_weighted_delete_subtracts(spark):
    arcs = graph.arcs_of(edges_frame(spark, [(0, 1, 3), (1, 2, 1)]), True)
    got = dynamic.apply_deletes(arcs, edges_frame(spark, [(1, 0, 2), (2, 1, 1)]), True)
    assert {tuple(r) for r in got.collect()} == {(0, 1, 1.0), (1, 0, 1.0)}


def test_graph_emptied_by_deletions(spark):
    arcs, nodes = run.load_graph(spark.createDataFrame([(0, 1)], "src long, dst long"))
    labels = labels_frame(spark, {0: 0, 1: 0})
    dels = spark.createDataFrame([(0, 1)], "src long, dst long")
    arcs, nodes, labels, report = run.half_step(arcs, nodes, labels, dels, "del")
    assert report.quality == 0 and report.arcs == 0


def test_empty_graph_scores_zero(spark, toy):
    arcs, nodes = toy
    assert quality.score(0, arcs.limit(0), nodes, louvain.identity_labels(nodes)).first()["q"] == 0
    assert louvain.modularity(arcs.limit(0), louvain.identity_labels(nodes)) == 0


def test_unknown_mode_is_an_error(toy):
    with pytest.raises(ValueError):
        run.half_step(*toy, None, None, "add", "sideways")


def test_hierarchy_levels(spark, toy):
    got = run.detect(*toy)
    assert hierarchy.count_levels(got.hierarchy) == len(got.metrics)
    assert partition(hierarchy.flatten(got.hierarchy)) == partition(got.labels)
    assert len(partition(hierarchy.flatten(got.hierarchy, 0))) == 14
    with pytest.raises(ValueError):
        hierarchy.flatten(got.hierarchy, 99)
    pairs = hierarchy.comembership_pairs(got.labels).count()
    assert pairs == 3 * 6 and hierarchy.comembership_matrix(got.labels).filter("same = 1").count() == 14 + 2 * pairs


# files


def test_files_round_trip(spark, toy, tmp_path):
    arcs, nodes = toy
    (tmp_path / "e.txt").write_text("\n".join(f"{a} {b}" for a, b in tables.TOY_EDGES) + "\n\n")
    again = graph.arcs_of(files.read_edges(spark, str(tmp_path / "e.txt")))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in arcs.collect()}
    files.write_parquet_graph(arcs, nodes, str(tmp_path / "g"))
    a, n = files.read_parquet_graph(spark, str(tmp_path / "g"))
    assert a.count() == arcs.count() and n.count() == 14
    files.write_edges(arcs, str(tmp_path / "half"), half=True)
    assert spark.read.text(str(tmp_path / "half")).count() == 18
    files.write_adjacency(arcs, str(tmp_path / "adj"))
    assert "10: 11 12 13" in {r[0] for r in spark.read.text(str(tmp_path / "adj")).collect()}
    labels = labels_frame(spark, P)
    files.write_partition(labels, str(tmp_path / "p"))
    assert partition(files.read_partition(spark, str(tmp_path / "p"), nodes)) == partition(labels)
    files.write_cluster_sizes(labels, str(tmp_path / "sizes"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sizes")).collect()) == ["1", "1", "4", "4", "4"]
    files.write_members(labels, str(tmp_path / "members"))
    assert "0 1 2 4" in {r[0] for r in spark.read.text(str(tmp_path / "members")).collect()}
    files.write_relabel_map(graph.renumber_map(arcs), str(tmp_path / "map"))
    assert spark.read.text(str(tmp_path / "map")).count() == 12


def test_weights_and_matrix_market(spark, tmp_path):
    (tmp_path / "w.txt").write_text("0 1 2.5\n1\t2\n")
    assert {tuple(r) for r in files.read_edges(spark, str(tmp_path / "w.txt"), True).collect()} == {(0, 1, 2.5), (1, 2, 1.0)}
    (tmp_path / "m.mtx").write_text("% a comment\n3 3 2\n1 2 4\n2 3 1\n")
    assert {tuple(r) for r in files.read_matrix_market(spark, str(tmp_path / "m.mtx")).collect()} == {(0, 1, 4.0), (1, 2, 1.0)}


def test_change_files_may_be_missing(spark, tmp_path):
    (tmp_path / "d0.txt").write_text("0 1\n1 2\n\n")
    (tmp_path / "a1.txt").write_text("3 4\n")
    got = files.read_changes(spark, str(tmp_path / "d"), str(tmp_path / "a"), 1)
    assert {tuple(r)[:4] for r in got.collect()} == {(0, "del", 0, 1), (0, "del", 1, 2), (1, "add", 3, 4)}
    assert files.read_changes(spark, None, None, 1).count() == 0


def test_hierarchy_files(spark, toy, tmp_path):
    got = run.detect(*toy)
    for _ in range(2):  # a step that is written again replaces itself
        files.write_hierarchy(got.hierarchy, str(tmp_path / "h"), 3)
    assert files.read_hierarchy(spark, str(tmp_path / "h"), 3).count() == got.hierarchy.count()
    (tmp_path / "tree").write_text("0 0\n1 0\n2 1\n0 0\n1 0\n")
    rows = {tuple(r) for r in files.read_hierarchy_text(spark, str(tmp_path / "tree")).collect()}
    assert rows == {(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 1, 0)}


# stream


def test_stream_reaches_the_batch_result(spark, tmp_path):
    state = stream.start_state(spark, tables.toy_edges(spark), str(tmp_path / "state"))
    rows = tables.toy_changes(spark).selectExpr("step", "op", "src", "dst", "1.0D as w")
    rows.coalesce(1).write.json(str(tmp_path / "in"))
    stream.keep_up(stream.read_change_stream(spark, str(tmp_path / "in")), state, str(tmp_path / "cp")).awaitTermination()
    reports = state.reports().orderBy("step", "op").collect()
    assert sorted(round(r["quality"], 6) for r in reports) == sorted(round(float(Fraction(q)), 6) for _, _, q in STEPS)
    # a batch of steps that are over goes to the late table and changes nothing
    before = state.versions()
    stream.apply_batch(state, rows, 7)
    assert state.versions() == before
    assert spark.read.parquet(str(tmp_path / "state/late/batch=7")).count() == rows.count()


def test_running_degrees(spark):
    got = {r["id"]: r["change"] for r in stream.running_degrees(tables.toy_changes(spark)).collect()}
    assert got[10] == -3 + 2 and got[0] == -1 and got[14] == 2


def test_timers():
    t = Timers()
    with t("all"):
        with t("part"):
            pass
    assert [(d, n) for d, n, _, _ in t.tree()] == [(0, "all"), (1, "part")]
    assert t.summary()["all"][0] == 1


def test_screening_on_arrays_and_dataframes_agree(spark, toy):
    labels = materialize(labels_frame(spark, P), "labels")
    for op in ("del", "add"):
        batch = tables.toy_changes(spark).filter(f"step = 0 and op = '{op}'")
        reports = [run.half_step(*toy, labels, batch, op, local_arcs=n)[3] for n in (run.LOCAL_ARCS, 0)]
        assert (reports[0].r_size, reports[0].quality) == (reports[1].r_size, pytest.approx(reports[1].quality))


def _wheels(spark, kind):
    """Rings of eight with a hub that sees all, loops, unlinked vertices, and gaps in the ids; edges have weights of the kind."""
    rng = np.random.default_rng(11)
    edges = {(8 * r + i, 8 * r + (i + j) % 8) for r in range(12) for i in range(8) for j in (1, 2)} | {(200, v) for v in range(0, 96, 2)} | {(5, 5), (200, 200), (40, 41)}
    edges |= {tuple(map(int, rng.integers(0, 96, 2))) for _ in range(40)}
    rows = [(3 * min(e) + 7, 3 * max(e) + 7, w) for e, w in zip(sorted(edges), rng.integers(1, 5, len(edges)).tolist())]
    frame = spark.createDataFrame([(a, b, w / 4 if kind == "double" else w) for a, b, w in rows], f"src long, dst long, w {kind}")
    arcs = materialize(graph.arcs_of(frame, True), "arcs")
    ids = sorted({x for a, b, _ in rows for x in (a, b)} | {0, 1000})
    return arcs, spark.createDataFrame([(i, 1) for i in ids], "id long, node_w long"), len(ids)


@pytest.mark.parametrize("kind", ["long", "double"])
def test_levels_dealt_over_tasks(spark, kind, monkeypatch):
    """With a bound between vertices and arcs a level gives what the array level loop gives: from singletons, from communities, with a subset."""
    from graphloom.plans import dealt_level

    monkeypatch.setattr(dealt_level, "ROW_ARCS", 20)
    monkeypatch.setattr(dealt_level, "TASK_ARCS", 100)
    arcs, nodes, n = _wheels(spark, kind)
    assert n < arcs.count()
    warm = nodes.select("id", (1000 - F.floor(F.col("id") / 30)).cast("long").alias("comm"))
    for labels, subset, bad in ((None, None, "keep"), (warm, None, "keep"), (warm, nodes.filter("id % 2 = 0").select("id"), "revert")):
        dealt, whole = (run.detect(arcs, nodes, labels, subset, local_arcs=bound, on_bad_pass=bad) for bound in (n, run.LOCAL_ARCS))
        assert sorted(dealt.labels.collect()) == sorted(whole.labels.collect())
        keys = ("level", "nodes", "arcs", "passes")
        assert [[m[x] for x in keys] for m in dealt.metrics] == [[m[x] for x in keys] for m in whole.metrics]
        assert [m["quality"] for m in dealt.metrics] == pytest.approx([m["quality"] for m in whole.metrics], abs=0 if kind == "long" else 1e-12)
        assert sorted(dealt.hierarchy.collect()) == sorted(whole.hierarchy.collect())


def test_levels_dealt_over_tasks_take_few_jobs(spark):
    """A bucket step is one job, as is the score of a pass."""
    arcs, nodes, n = _wheels(spark, "long")
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    got = run.detect(arcs, nodes, local_arcs=n, max_levels=1)
    assert jobs() - before <= got.metrics[0]["passes"] * 8 + 40
