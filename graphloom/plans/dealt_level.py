"""A level on arrays dealt over tasks, for graphs whose vertices fit a task and whose arcs don't.

Arcs are written once for a level, packed: a row holds all arcs of some sources of one degree bucket.  A bucket step is one map over the
rows of its bucket with the labels broadcast, and its moves come back to the driver.  The rules are those of operators.louvain under
modularity; a task holds arrays of all vertices, and the packed rows of one Arrow batch, at most those of its share of the files.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graphloom.functions import local_louvain
from graphloom.plans.store import materialize

#: Arcs of a packed row, but for one source more.
ROW_ARCS = 100_000
#: Arcs that a task packs, as sources are dealt by hash.
TASK_ARCS = 500_000

_PACKED = "bucket int, src binary, dst binary, w binary"


def _column(df: DataFrame, name: str) -> np.ndarray:
    return df.select(F.col(name).cast("long").alias(name)).toArrow().column(name).to_numpy()


def _pack(arcs: DataFrame, n_arcs: int, exact: bool, ids) -> DataFrame:
    """Rows of _PACKED; vertices are given by their places in ids (a broadcast; None if they are 0 to n - 1)."""
    most = ROW_ARCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows]
        if not got:
            return
        src, dst, w = (np.concatenate([g[i] for g in got]) for i in range(3))
        if ids is not None:
            src, dst = np.searchsorted(ids.value, src), np.searchsorted(ids.value, dst)
        order = np.lexsort((dst, src))
        src, dst, w = src[order], dst[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        degree = np.diff(np.append(first, len(src)))
        bucket = local_louvain.bucket_of(degree)
        for b in np.unique(bucket):
            mine = np.flatnonzero(bucket == b)
            row = (np.cumsum(degree[mine]) - degree[mine]) // most
            for who in np.split(mine, np.flatnonzero(np.diff(row)) + 1):
                count = degree[who]
                arc = np.repeat(first[who] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32())] + [pa.array([x[arc].tobytes()], pa.binary()) for x in (src.astype(np.int64), dst.astype(np.int64), w)], names=["bucket", "src", "dst", "w"])

    tasks = max(arcs.sparkSession.sparkContext.defaultParallelism, -(-n_arcs // TASK_ARCS))
    rows = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("long" if exact else "double").alias("w"))
    return materialize(rows.repartition(tasks, "src").mapInArrow(run, _PACKED), "packed", by="bucket")


def _map_rows(packed: DataFrame, exact: bool, start: Callable, a: str, b: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """f(src, dst, w) -> (array, array) of every packed row, with f = start() made once a task; a and b: the arrays' kinds."""
    kind = np.int64 if exact else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for i in range(batch.num_rows):
                src, dst, w = (np.frombuffer(batch.column(j)[i].as_buffer(), t) for j, t in enumerate((np.int64, np.int64, kind)))
                x, y = f(src, dst, w)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, t).tobytes()], pa.binary()) for v, t in ((x, a), (y, b))], names=["a", "b"])

    got = packed.select("src", "dst", "w").mapInArrow(run, "a binary, b binary").collect()
    return [(np.frombuffer(r["a"], a), np.frombuffer(r["b"], b)) for r in got]


def run_level(arcs: DataFrame, nodes: DataFrame, labels: DataFrame | None, subset: DataFrame | None, n_arcs: int, min_gain: float, max_passes: int, on_bad_pass: str) -> tuple[DataFrame, bool, int, float]:
    """(labels, whether a pass gained, passes, quality), as run.run_level under modularity; without labels from singletons."""
    sc, exact = arcs.sparkSession.sparkContext, dict(arcs.dtypes)["w"] not in ("double", "float")
    low, high, n = nodes.agg(F.min("id"), F.max("id"), F.count("*")).first()
    ids = None if (low, high) == (0, n - 1) else np.sort(_column(nodes, "id"))
    at = lambda v: v if ids is None else np.searchsorted(ids, v)
    names = np.arange(n) if ids is None else ids
    current = np.arange(n)
    if labels is not None:
        pairs = labels.select("id", "comm").toArrow()
        # communities keep their order, so ties go the same way
        names, current[at(pairs.column("id").to_numpy())] = np.unique(pairs.column("comm").to_numpy(), return_inverse=True)
    kept = []

    def send(value):
        kept.append(sc.broadcast(value))
        return kept[-1]

    sent_ids = None if ids is None else send(ids)
    packed = _pack(arcs, n_arcs, exact, sent_ids)
    number = "i8" if exact else "f8"

    def weights():
        def f(src, dst, w):
            first = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
            return src[first], np.add.reduceat(w, first)

        return f

    k = np.zeros(n, np.int64 if exact else float)
    for v, own in _map_rows(packed, exact, weights, "i8", number):
        k[v] = own
    m2 = int(k.sum()) if exact else math.fsum(k)
    present = [r["bucket"] for r in packed.select("bucket").distinct().orderBy("bucket").collect()]
    chosen = None
    if subset is not None:
        mask = np.zeros(n, bool)
        mask[at(_column(subset, "id"))] = True
        chosen = send(mask)
    sent_k = send(k)

    def score(labels: np.ndarray) -> float:
        if not m2:
            return 0.0
        sent = sc.broadcast(labels)

        def start():
            def f(src, dst, w):
                return [], [w[sent.value[src] == sent.value[dst]].sum()]

            return f

        sums = [x for _, part in _map_rows(packed, exact, start, "i8", number) for x in part]
        sent.destroy()
        tot = local_louvain._sums(labels, k, n)
        if exact:
            return (m2 * sum(map(int, sums)) - int((tot.astype(object) ** 2).sum())) / m2**2
        return (m2 * math.fsum(sums) - math.fsum(tot * tot)) / (m2 * m2)

    def moves(labels: np.ndarray, bucket: int) -> list[tuple[np.ndarray, np.ndarray]]:
        sent = sc.broadcast(labels)

        def start():
            labels, k = sent.value, sent_k.value
            tot, size = local_louvain._sums(labels, k, n), np.bincount(labels, minlength=n)

            def f(src, dst, w):
                if chosen is not None:
                    who = chosen.value[src]
                    src, dst, w = src[who], dst[who], w[who]
                return local_louvain.best_of(*local_louvain.grouped(src, dst, w, labels), labels, k, m2, tot, size)

            return f

        got = _map_rows(packed.filter(F.col("bucket") == bucket), exact, start, "i8", "i8")
        sent.destroy()
        return got

    q, improved, passes = score(current), False, 0
    while passes < max_passes:
        before, moved = current.copy(), 0
        for b in present:
            for v, c in moves(current, b):
                current[v] = c
                moved += len(v)
        passes += 1
        now = score(current)
        if now < q and on_bad_pass == "revert":
            current = before
            break
        improved |= now > q
        stop = now - q < min_gain or moved == 0
        q = now
        if stop:
            break
    comm = send(names[current])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_numpy(zero_copy_only=False)
            place = v if sent_ids is None else np.searchsorted(sent_ids.value, v)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(comm.value[place])], names=["id", "comm"])

    out = materialize(nodes.select(F.col("id").cast("long").alias("id")).mapInArrow(label, "id long, comm long"), "labels")
    for x in kept:
        x.destroy()
    return out, improved, passes, q
