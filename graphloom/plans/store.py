"""Intermediate tables in the shared folder.

Iterative plans write each step's small result there and read it again.  Lineage ends with the files, so a lost
executor costs the running step only.  clear() removes what a session has written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side is broadcast only if its files are smaller than this many bytes.
BROADCAST_BYTES = 16 * 1024 * 1024
#: Copies of a small side when a salted join replaces a broadcast.
SALTS = 32

_own_dir: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where it is unset and all runs on this machine."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="graphloom-")
    return _own_dir


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/graphloom-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str, files: int | None = None, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again; `by`: in a folder for each value of that column, so filters on it read one."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = (df.coalesce(files) if files else df).write
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session; results that were not yet written elsewhere are lost.  Returns their number."""
    n, jvm = len(_written), spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialized table, as the planner sees them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(left: DataFrame, small: DataFrame, key: str | list[str], how: str = "left", salt_by: Column | None = None) -> DataFrame:
    """Join a materialized table with unique `key` to a side whose keys may be very hot.

    Up to BROADCAST_BYTES of files the small side is broadcast.  Beyond that each of its rows is copied SALTS times and
    the left rows of a key are dealt over the copies, so one hot key never lands in one task.
    """
    if written_bytes(small) <= BROADCAST_BYTES:
        return left.join(F.broadcast(small), key, how)
    salt = F.pmod(F.xxhash64(salt_by if salt_by is not None else F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    copies = small.withColumn("__gl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [key] if isinstance(key, str) else list(key)
    return left.withColumn("__gl_salt", salt).join(copies, [*keys, "__gl_salt"], how).drop("__gl_salt")


def small(df: DataFrame) -> DataFrame:
    """A table with a broadcast hint if the planner knows it to be small; else as it is, and hot keys are left to adaptive skew joins."""
    return F.broadcast(df) if written_bytes(df) <= BROADCAST_BYTES else df
