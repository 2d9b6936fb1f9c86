"""Shared plumbing of the text operators: tables, columns, and what plans.store has."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from graphloom.plans.store import BROADCAST_BYTES, SALTS, join_small, materialize, new_path, shared_dir, written_bytes

__all__ = ["BROADCAST_BYTES", "SALTS", "annotate", "id_crc32_mod", "join_small", "kept_columns", "materialize", "new_path", "rename_clashes", "shared_dir", "strings", "table", "trimmed", "written_bytes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc32_mod(column: Column, m: int) -> Column:
    """crc32 of the decimal text of an id, modulo m."""
    return F.pmod(F.crc32(F.encode(column.cast("string"), "UTF-8")), F.lit(m))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives freed memory back to the system, so that an idle worker process holds little."""

    def then_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return then_trim


def rename_clashes(df: DataFrame, names: list[str]) -> DataFrame:
    """df with its columns of these names (compared without case, as Spark does) called input_<name>, with more underscores while that is taken."""
    new, taken = {n.lower() for n in names}, {c.lower() for c in [*df.columns, *names]}
    out = []
    for c in df.columns:
        name = c
        if c.lower() in new:
            name = f"input_{c}"
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        out.append(name)
    return df.toDF(*out)


def annotate(df: DataFrame, columns: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """Append `fields` to every row of df, computed in Arrow batches from `columns`.

    make() runs once in each task and returns the batch function.  Rows, their order and all other columns pass
    unchanged; a column of df that has the name of one of `fields` stays, named input_<name>.
    """
    at = [df.columns.index(c) for c in columns]
    df = rename_clashes(df, [f.name for f in fields])
    schema = T.StructType(df.schema.fields + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            got = call([batch.column(i) for i in at])
            yield pa.RecordBatch.from_arrays(list(batch.columns) + got, names=names)

    return df.mapInArrow(trimmed(run), schema)


def kept_columns(df: DataFrame) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """(df with columns c0, c1, ..., the columns that restore its names, name: its new name): operators' own columns can't clash then."""
    columns = df.columns
    renamed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return renamed, [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], {c: f"c{i}" for i, c in enumerate(columns)}


def strings(array: pa.Array) -> list[str]:
    """Texts of a column, null as empty."""
    return [x if x is not None else "" for x in array.to_pylist()]
