"""A continuous feed of changes kept up by Structured Streaming.

Micro-batches of (step, op, src, dst, w) are applied in ascending order of step, deletions before additions.  The state is
versioned: each step writes its arcs, nodes, labels and report under a folder of its own and then a commit
marker, so a batch that runs again after a failure replaces what it had written.  Steps that aren't later than the last
committed one go to a table of late changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans import run
from graphloom.sources.files import CHANGES

C = F.col


class GraphState:
    """Versions of a graph and its communities under a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Committed versions, by their markers."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit())

    def commit(self, version: int) -> None:
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{version}")
        marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(marker, True).close()

    def write(self, version: int, arcs: DataFrame, nodes: DataFrame, labels: DataFrame, report: DataFrame) -> None:
        for name, df in (("arcs", arcs), ("nodes", nodes), ("labels", labels), ("report", report)):
            df.write.mode("overwrite").parquet(f"{self.path}/{name}/v={version}")
        self.commit(version)

    def read(self, version: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        version = self.versions()[-1] if version is None else version
        return tuple(self.spark.read.parquet(f"{self.path}/{name}/v={version}") for name in ("arcs", "nodes", "labels"))

    def reports(self) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/report/v={v}" for v in self.versions()])


def start_state(spark: SparkSession, edges: DataFrame, path: str, weighted: bool = False, mode: str = "delta", **options) -> GraphState:
    """Version 0: the start graph and its communities."""
    state = GraphState(spark, path)
    arcs, nodes = run.load_graph(edges, weighted)
    got = run.detect(arcs, nodes, **options)
    n = nodes.count()
    report = run.Step(-1, "start", n, arcs.count(), n, got.quality, len(got.metrics), 0.0, 0.0, got.hierarchy)
    state.write(0, arcs, nodes, got.labels, run.report_frame(spark, [report], mode))
    return state


def apply_batch(state: GraphState, batch: DataFrame, batch_id: int, mode: str = "delta", weighted: bool = False, **options) -> None:
    """One micro-batch: version s + 1 is the graph after step s."""
    batch = batch.persist()
    try:
        last = state.versions()[-1] - 1
        late = batch.filter(C("step") <= last)
        if late.head(1):
            late.write.mode("overwrite").parquet(f"{state.path}/late/batch={batch_id}")
        present = sorted({(r["step"], r["op"]) for r in batch.filter(C("step") > last).select("step", "op").distinct().collect()})
        for step in sorted({s for s, _ in present}):
            arcs, nodes, labels = state.read()
            reports = []
            for op in ("del", "add"):
                if (step, op) in present:
                    changes = batch.filter((C("step") == step) & (C("op") == op))
                    arcs, nodes, labels, report = run.half_step(arcs, nodes, labels, changes, op, mode, weighted, step, **options)
                    reports.append(report)
            state.write(step + 1, arcs, nodes, labels, run.report_frame(state.spark, reports, mode))
    finally:
        batch.unpersist()


def read_change_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Changes from JSON files that arrive in a folder."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_per_batch).json(path)


def keep_up(changes: DataFrame, state: GraphState, checkpoint: str, mode: str = "delta", weighted: bool = False, available_now: bool = True, **options) -> StreamingQuery:
    """Start the query that applies a change stream to the state."""
    writer = changes.writeStream.foreachBatch(lambda df, i: apply_batch(state, df, i, mode, weighted, **options)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def running_degrees(changes: DataFrame) -> DataFrame:
    """(id, change): additions less deletions at each vertex, for streams and batches: a keyed aggregate that needs no graph."""
    sign = F.when(C("op") == "add", F.lit(1)).otherwise(F.lit(-1))
    ends = F.explode(F.when(C("src") == C("dst"), F.array("src")).otherwise(F.array("src", "dst")))
    return changes.select(ends.alias("id"), sign.alias("d")).groupBy("id").agg(F.sum("d").alias("change"))
