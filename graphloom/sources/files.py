"""Reading and writing graphs, changes, partitions and hierarchies.

Text rows are separated by white space; schemas are fixed, nothing is inferred.  Parquet takes the place of a binary
adjacency format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.operators import graph, hierarchy

C = F.col


def _fields(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(f, file): the fields of each row that has some."""
    raw = spark.read.text(path).select("value", C("_metadata.file_path").alias("file"))
    return raw.select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("f"), "file").filter(C("f")[0] != "")


def _edge(weighted: bool) -> list[Column]:
    w = F.coalesce(F.get("f", F.lit(2)).try_cast("double"), F.lit(1.0)) if weighted else F.lit(1.0)
    return [C("f")[0].cast("long").alias("src"), C("f")[1].cast("long").alias("dst"), w.alias("w")]


def read_edges(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst, w) from rows `src dst [weight]`; the weight is 1 where there is none."""
    return _fields(spark, path).select(*_edge(weighted))


def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) from rows `v1 v2 w` below `%` comments and a line of sizes; numbering starts at 1 there."""
    rows = _fields(spark, path).filter(~F.startswith(C("f")[0], F.lit("%"))).withColumn("at", F.monotonically_increasing_id())
    # the line of sizes is the first one left
    head = rows.agg(F.min("at").alias("head"))
    rows = rows.crossJoin(F.broadcast(head)).filter("at > head")
    return rows.select((C("f")[0].cast("long") - 1).alias("src"), (C("f")[1].cast("long") - 1).alias("dst"), F.coalesce(F.get("f", F.lit(2)).try_cast("double"), F.lit(1.0)).alias("w"))


CHANGES = "step int, op string, src long, dst long, w double"


def read_changes(spark: SparkSession, del_prefix: str | None, add_prefix: str | None, steps: int, weighted: bool = False) -> DataFrame:
    """(step, op, src, dst, w) from files <prefix><step>.txt, steps 0 to `steps`; a missing file is an empty batch, so is a missing prefix."""
    out = spark.createDataFrame([], CHANGES)
    for op, prefix in (("del", del_prefix), ("add", add_prefix)):
        if prefix is None:
            continue
        for step in range(steps + 1):
            try:
                rows = _fields(spark, f"{prefix}{step}.txt")
            except AnalysisException as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            out = out.unionByName(rows.select(F.lit(step).alias("step"), F.lit(op).alias("op"), *_edge(weighted)))
    return out


def read_partition(spark: SparkSession, path: str, nodes: DataFrame | None = None) -> DataFrame:
    """(id, comm) from rows `node comm`; nodes without a row are communities of their own."""
    rows = _fields(spark, path).select(C("f")[0].cast("long").alias("id"), C("f")[1].cast("long").alias("comm"))
    if nodes is None:
        return rows
    return nodes.select("id").join(rows, "id", "left").select("id", F.coalesce("comm", "id").alias("comm"))


def read_hierarchy_text(spark: SparkSession, path: str) -> DataFrame:
    """(level, node, comm) from one file of rows `node comm`, in which a row of node 0 starts a new level.

    The file is read in order; a level starts at a number of rows that running sums of small blocks give.
    """
    rows = _fields(spark, path).select(C("f")[0].cast("long").alias("node"), C("f")[1].cast("long").alias("comm")).withColumn("at", F.monotonically_increasing_id())
    starts = rows.filter("node = 0").select("at")
    levels = starts.groupBy().agg(F.sort_array(F.collect_list("at")).alias("starts"))  # one entry for each level
    return rows.crossJoin(F.broadcast(levels)).select((F.size(F.filter("starts", lambda s: s <= C("at"))) - 1).alias("level"), "node", "comm")


def write_parquet_graph(arcs: DataFrame, nodes: DataFrame, path: str) -> None:
    arcs.write.mode("overwrite").parquet(f"{path}/arcs")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")


def read_parquet_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(arcs, nodes); fails on a folder that holds no graph."""
    arcs, nodes = spark.read.parquet(f"{path}/arcs"), spark.read.parquet(f"{path}/nodes")
    for df, names in ((arcs, {"src", "dst", "w"}), (nodes, {"id", "node_w"})):
        if missing := names - set(df.columns):
            raise ValueError(f"{path}: no column {sorted(missing)}")
    return arcs, nodes


def _rows(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.concat_ws(" ", *[C(c).cast("string") for c in columns]).alias("value"))


def write_edges(arcs: DataFrame, path: str, weighted: bool = False, half: bool = False) -> None:
    """Rows `src dst [w]`: all arcs, or each edge once."""
    df = graph.half_edges(arcs) if half else arcs
    _rows(df, "src", "dst", *(["w"] if weighted else [])).write.mode("overwrite").text(path)


def write_adjacency(arcs: DataFrame, path: str, weighted: bool = False) -> None:
    """Rows `v: n1 n2 ...` or `v: (n1 w1) ...`."""
    entry = (lambda x: F.concat(F.lit("("), x["dst"].cast("string"), F.lit(" "), x["w"].cast("string"), F.lit(")"))) if weighted else (lambda x: x["dst"].cast("string"))
    text = F.concat(C("id").cast("string"), F.lit(": "), F.array_join(F.transform("neighbours", entry), " "))
    graph.adjacency_lists(arcs).select(text.alias("value")).write.mode("overwrite").text(path)


def write_relabel_map(mapping: DataFrame, path: str) -> None:
    _rows(mapping, "old_id", "new_id").write.mode("overwrite").text(path)


def write_partition(labels: DataFrame, path: str) -> None:
    _rows(labels, "id", "comm").write.mode("overwrite").text(path)


def write_hierarchy(levels: DataFrame, path: str, step: int = 0) -> None:
    """(level, node, comm) under path, by step and level; a step that is written again replaces itself."""
    levels.write.mode("overwrite").partitionBy("level").parquet(f"{path}/step={step}")


def read_hierarchy(spark: SparkSession, path: str, step: int = 0) -> DataFrame:
    return spark.read.parquet(f"{path}/step={step}").select("level", "node", "comm")


def write_cluster_sizes(labels: DataFrame, path: str) -> None:
    _rows(hierarchy.cluster_sizes(labels).orderBy("comm"), "size").write.mode("overwrite").text(path)


def write_members(labels: DataFrame, path: str) -> None:
    """Members, one community in each row, communities in order."""
    rows = hierarchy.community_members(labels).orderBy("comm")
    rows.select(F.array_join(F.transform("members", lambda x: x.cast("string")), " ").alias("value")).write.mode("overwrite").text(path)


def write_metrics(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)
