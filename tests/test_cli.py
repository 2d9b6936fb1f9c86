"""The command line, and the level loop under the other criteria."""

import pytest

from graphloom import cli
from graphloom.functions import quality
from graphloom.operators import louvain
from graphloom.plans import run
from graphloom.sources import files, tables


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("cli")
    (path / "e.txt").write_text("\n".join(f"{a} {b}" for a, b in tables.TOY_EDGES))
    for step, op, a, b in tables.TOY_CHANGES:
        with (path / f"{op}{step}.txt").open("a") as f:
            f.write(f"{a} {b}\n")
    cli.main(["convert", "-i", str(path / "e.txt"), "-o", str(path / "g")])
    return path


def test_convert_and_renumber(spark, folder):
    cli.main(["convert", "-i", str(folder / "e.txt"), "-o", str(folder / "r"), "-r", str(folder / "map")])
    _, nodes = files.read_parquet_graph(spark, str(folder / "r"))
    assert nodes.count() == 12 and spark.read.text(str(folder / "map")).count() == 12


def test_detect_and_matrix(spark, folder, capsys):
    cli.main(["detect", str(folder / "g"), "-o", str(folder / "d")])
    assert "0.549382" in capsys.readouterr().out
    assert cli.matrix(spark, str(folder / "d/hierarchy")).orderBy("level").first()["nodes"] == 14
    assert cli.matrix(spark, str(folder / "d/hierarchy"), -2).count() == 18
    cli.main(["detect", str(folder / "g"), "-o", str(folder / "again"), "-p", str(folder / "d/labels")])


def test_matrix_prints_all_rows(spark, tmp_path, capsys):
    rows = spark.range(40).selectExpr("0 AS level", "id AS node", "id % 2 AS comm")
    files.write_hierarchy(rows, str(tmp_path / "h"))
    cli.main(["matrix", str(tmp_path / "h"), "-l", "1", "-d"])
    assert len(capsys.readouterr().out.splitlines()) >= 1600


def test_detect_starts_from_partition_under_any_criterion(spark, folder, tmp_path):
    """All in one community stays together: moves of single vertices out of it are never to an empty one."""
    (tmp_path / "p.txt").write_text("\n".join(f"{i} 0" for i in range(14)))
    got = cli.detect(spark, str(folder / "g"), str(tmp_path / "o"), criterion=1, start=str(tmp_path / "p.txt"))
    assert got.metrics[1]["nodes"] == 1


def test_steps(spark, folder):
    cli.main(["steps", str(folder / "g"), "-o", str(folder / "s"), "-a", "1", "-x", str(folder / "del"), "-b", str(folder / "add")])
    rows = spark.read.json(str(folder / "s/report")).collect()
    assert round(max(r["quality"] for r in rows), 6) == 0.594183
    assert all(r["screening_ms"] > 0 for r in rows if r["op"] != "start")
    # after the static run and each half step: hierarchy, sizes of communities, members
    for i, (vertices, communities) in enumerate([(14, 5), (14, 5), (16, 5), (16, 5), (17, 5)]):
        sizes = [int(r[0]) for r in spark.read.text(str(folder / f"s/sizes/step={i}")).collect()]
        members = [r[0].split() for r in spark.read.text(str(folder / f"s/members/step={i}")).collect()]
        assert sum(sizes) == vertices and sorted(sizes) == sorted(map(len, members)) and len(sizes) >= communities
        levels = files.read_hierarchy(spark, str(folder / "s/hierarchy"), i)
        assert levels.filter("level = 0").count() == vertices
    times = {r["name"] for r in spark.read.json(str(folder / "s/times")).collect()}
    assert {"static run", "step 0 del", "step 1 add", "apply changes"} <= times


def test_steps_under_a_criterion_from_a_partition(spark, folder, tmp_path):
    (tmp_path / "p.txt").write_text("0 0\n1 0\n2 0\n4 0\n")
    cli.main(["steps", str(folder / "g"), "-o", str(tmp_path / "s"), "-a", "0", "-x", str(folder / "del"), "-q", "1", "-m", "full", "-p", str(tmp_path / "p.txt")])
    rows = {r["op"]: r for r in spark.read.json(str(tmp_path / "s/report")).collect()}
    assert set(rows) == {"start", "del"} and rows["start"]["quality"] == pytest.approx(87 / 98)


def test_detect_prints_the_graph_of_a_level(spark, folder, tmp_path, capsys):
    cli.main(["detect", str(folder / "g"), "-o", str(tmp_path / "d"), "-l", "2"])
    shown = [x for x in capsys.readouterr().out.splitlines() if ": (" in x]
    first = files.read_hierarchy(spark, str(tmp_path / "d/hierarchy")).filter("level = 1").count()
    assert 3 <= len(shown) <= first < 14
    assert sum(float(w.rstrip(")")) for x in shown for w in x.split(": ")[1].split()[1::2]) == 36


@pytest.mark.parametrize("which", [0, 1, 4, 8])
def test_level_loop_by_criterion(spark, which):
    arcs, nodes = run.load_graph(tables.toy_edges(spark))
    got = run.detect_by(which, arcs, nodes)
    start = quality.score(which, arcs, nodes, louvain.identity_labels(nodes)).first()["q"]
    assert got.quality > start
    assert quality.score(which, arcs, nodes, got.labels).first()["q"] == pytest.approx(got.quality, abs=1e-8)
    if which == 0:
        assert got.quality == pytest.approx(89 / 162)
