"""Nested wall-clock timers and their report."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Timer:
    """Sums the time of its `with` blocks."""

    def __init__(self) -> None:
        self.ms = 0.0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_: object) -> None:
        self.ms += 1000 * (time.perf_counter() - self._began)


class Timers:
    """Timers in a hierarchy: a block opened inside another one is its part."""

    def __init__(self) -> None:
        self._open: list[int] = []
        self.rows: list[list] = []  # name, parent, ms, start

    @contextmanager
    def __call__(self, name: str):
        parent = self._open[-1] if self._open else None
        k = len(self.rows)
        self.rows.append([name, parent, 0.0, time.perf_counter()])
        self._open.append(k)
        try:
            yield
        finally:
            self._open.pop()
            self.rows[k][2] = 1000 * (time.perf_counter() - self.rows[k][3])

    def tree(self) -> list[tuple[int, str, float, float | None]]:
        """(depth, name, ms, percent of the parent) in order of start."""
        depth: list[int] = []
        out = []
        for name, parent, ms, _ in self.rows:
            depth.append(0 if parent is None else depth[parent] + 1)
            share = None if parent is None or not self.rows[parent][2] else 100 * ms / self.rows[parent][2]
            out.append((depth[-1], name, ms, share))
        return out

    def summary(self) -> dict[str, tuple[int, float]]:
        """name: (blocks, ms in all)."""
        out: dict[str, tuple[int, float]] = {}
        for name, _, ms, _ in self.rows:
            n, total = out.get(name, (0, 0.0))
            out[name] = (n + 1, total + ms)
        return out

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *row) for i, row in enumerate(self.tree())], "position int, depth int, name string, ms double, percent_of_parent double")
