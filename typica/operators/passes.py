"""Passes over rows that add up sums, for fits that go over all of their rows again and again.

Rows that fit into one block are held by the driver; more are summed on the executors, pass by pass. The sums, and so the
fits, are the same up to rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typica.operators.blocks import columns_of, matrix

#: Rows up to which the driver holds them, and from which mixtures take their starting points.
HELD_ROWS, SEED_ROWS = 50_000, 50_000
#: Rows that a pass takes at once on the executors.
PASS_ROWS = 4_096
#: Places at which the partial sums of a pass meet before the driver adds them up.
MEETING = 32


def sample(rows: DataFrame, most: int = SEED_ROWS) -> np.ndarray:
    """The most rows of the smallest id hashes; a bound on the hash first, so that tasks pass on few."""
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    near = rows.where(h < int((1 << 40) * min(1.0, (1.5 * most + 50) / max(1, rows.count()))))
    return matrix(near.orderBy(h, "id").limit(most).select("v").toArrow().column(0).combine_chunks())


class Rows:
    """Vectors to fit: a matrix, or a DataFrame (id, v, ...), which is cached for the passes if the driver can't hold it."""

    def __init__(self, rows: np.ndarray | DataFrame, most: int | None = None):
        self.frame: DataFrame | None = None
        self.spark = None if isinstance(rows, np.ndarray) else rows.sparkSession
        most = HELD_ROWS if most is None else most
        if isinstance(rows, np.ndarray):
            self.x, self.n = rows, len(rows)
        else:
            held = rows.select("id", "v").limit(most + 1).toArrow()
            self.n = held.num_rows if held.num_rows <= most else rows.count()
            if held.num_rows <= most:
                self.x = columns_of(held.sort_by("id"))[1]  # tasks end in any order, but starts are drawn by place
            else:
                self.frame = rows.select("id", "v").persist(StorageLevel.MEMORY_AND_DISK)
                self.x = np.array([self.frame.first()["v"]], np.float64)
        self.d = self.x.shape[1]

    def some(self, most: int | None = None) -> np.ndarray:
        """A bounded sample."""
        most = SEED_ROWS if most is None else most
        return self.x[:most] if self.frame is None else sample(self.frame, most)

    def sums(self, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """work (of a matrix of some rows: a vector of sums), added up over all rows."""
        if self.frame is None:
            return np.sum([work(self.x[lo : lo + 20_000]) for lo in range(0, max(1, self.n), 20_000)], axis=0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                x = matrix(b.column(0))
                for lo in range(0, len(x), PASS_ROWS):
                    now = work(x[lo : lo + PASS_ROWS])
                    total = now if total is None else total + now
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["x"])

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [matrix(b.column(0)).sum(0) for b in batches if b.num_rows]
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(parts, axis=0).tolist()], pa.list_(pa.float64()))], ["x"])

        parts = self.frame.select("v").mapInArrow(run, "x array<double>")
        met = parts.repartition(MEETING, F.monotonically_increasing_id()).mapInArrow(meet, "x array<double>")
        return np.sum([r["x"] for r in met.collect()], axis=0)  # MEETING rows at most

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and unbiased covariance, from sums about one of the rows."""
        origin, d = self.x[0], self.d
        s = self.sums(lambda x: np.concatenate(((x - origin).sum(0), ((x - origin).T @ (x - origin)).ravel())))
        mean = s[:d] / self.n
        return mean + origin, (s[d:].reshape(d, d) - self.n * np.outer(mean, mean)) / max(1, self.n - 1)

    def done(self) -> None:
        if self.frame is not None:
            self.frame.unpersist()


@contextmanager
def as_rows(x: np.ndarray | DataFrame | Rows) -> Iterator[Rows]:
    """x to fit; what was cached for this is released."""
    rows = x if isinstance(x, Rows) else Rows(x)
    try:
        yield rows
    finally:
        if rows is not x:
            rows.done()
