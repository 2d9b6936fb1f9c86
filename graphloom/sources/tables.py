"""Test graphs from the driver's tables: planted blocks, part-supplier, trade between nations, user-event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

C = F.col

#: Offsets that keep the two sides of bipartite graphs apart (fixed values).
SUPPLIER_OFFSET = 1_000_000
EVENT_OFFSET = 100_000

#: The toy graph with its changes (fixed values).
TOY_EDGES = ((0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4), (2, 6), (4, 5), (5, 6), (5, 7), (5, 8), (6, 7), (6, 8), (10, 11), (10, 12), (10, 13), (11, 12), (11, 13))
TOY_CHANGES = (
    (0, "del", 0, 1), (0, "del", 1, 2), (0, "add", 3, 9), (0, "add", 4, 6), (0, "add", 14, 15),
    (1, "del", 10, 11), (1, "del", 10, 12), (1, "del", 10, 13), (1, "add", 3, 10), (1, "add", 9, 10), (1, "add", 14, 16),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toy_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOY_EDGES), "src long, dst long")


def toy_changes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOY_CHANGES), "step int, op string, src long, dst long")


_BLOCK = ("c_nationkey", "c_mktsegment")


def planted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), src < dst: customers of a block with the next three, and sparse edges across."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", *_BLOCK)
    w = Window.partitionBy(*_BLOCK).orderBy("c_custkey")
    following = customers.withColumn("bs", F.array(*[F.lead("c_custkey", i).over(w) for i in (1, 2, 3)]))
    ahead = following.select(C("c_custkey").alias("a"), F.explode("bs").alias("b"))
    n = customers.agg(F.count("*").alias("n"))
    across = table(spark, sf_dir, "orders").filter(C("o_orderkey") % 20 == 0).crossJoin(F.broadcast(n)).select(C("o_custkey").alias("a"), ((C("o_custkey") * 7 + C("o_orderkey")) % C("n")).alias("b"))
    both = ahead.union(across).filter("a is not null and b is not null and a <> b")
    return both.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def planted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, comm): the smallest customer of the block."""
    customers = table(spark, sf_dir, "customer")
    return customers.select(C("c_custkey").alias("id"), F.min("c_custkey").over(Window.partitionBy(*_BLOCK)).alias("comm"))


def ps_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): parts with suppliers, weighted by line items."""
    items = table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("src"), (C("l_suppkey") + SUPPLIER_OFFSET).alias("dst"))
    return items.groupBy("src", "dst").agg(F.count("*").alias("w"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w), src <= dst: nations of customers and suppliers, weighted by line items."""
    items = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("o_orderkey"), C("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", C("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", C("c_nationkey").cast("long").alias("a"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", C("s_nationkey").cast("long").alias("b"))
    pairs = items.join(orders, "o_orderkey").join(customers, "c_custkey").join(suppliers, "s_suppkey")
    return pairs.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count("*").alias("w"))


def trade_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, comm): regions of nations."""
    return table(spark, sf_dir, "nation").select(C("n_nationkey").cast("long").alias("id"), C("n_regionkey").cast("long").alias("comm"))


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, src, dst): users with event types, by day."""
    events = table(spark, sf_dir, "events")
    types = events.select("event_type").distinct().withColumn("dst", F.dense_rank().over(Window.orderBy("event_type")).cast("long") + EVENT_OFFSET)
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return events.join(F.broadcast(types), "event_type").select(day.alias("step"), C("user_id").alias("src"), "dst")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, w): weighted by events."""
    return event_rows(spark, sf_dir).groupBy("src", "dst").agg(F.count("*").alias("w"))
