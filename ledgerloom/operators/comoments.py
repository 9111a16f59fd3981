"""Pairwise co-moments of many columns as mergeable matrices: one scan, one small row per task."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tasks that merge the tasks' matrices before the last one does.
MERGERS = 16
#: A spread below this share of the squared distance from the reference value is rounding.
ROUNDING = 1e-13


class CoMoments:
    """For each pair (i, j), over the rows where both are present: their number ``n[i, j]``, the mean
    ``mean[i, j]`` of i, the sum of products of deviations ``joint[i, j]`` and of squares ``own[i, j]`` of i."""

    def __init__(self, parts: np.ndarray):
        self.n, self.mean, self.joint, self.own = parts

    @staticmethod
    def of(rows: np.ndarray) -> CoMoments:
        """From rows of doubles in which a missing value is NaN."""
        there = ~np.isnan(rows)
        # Distances from a value that occurs: exactly 0 in a constant column, and small sums elsewhere.
        first = np.where(there.any(axis=0), rows[there.argmax(axis=0), np.arange(rows.shape[1])], 0.0)
        x, seen = np.where(there, rows - first, 0.0), there.astype(float)
        n = seen.T @ seen
        mean = np.divide(x.T @ seen, n, out=np.zeros_like(n), where=n > 0)
        squares = (x * x).T @ seen
        own = squares - n * mean * mean
        own[own <= ROUNDING * squares] = 0.0
        return CoMoments(np.stack([n, mean + np.where(n > 0, first[:, None], 0.0), x.T @ x - n * mean * mean.T, own]))

    def merge(self, other: CoMoments) -> CoMoments:
        n = self.n + other.n
        gap = np.where((self.n > 0) & (other.n > 0), other.mean - self.mean, 0.0)
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        weight = self.n * share
        mean = np.where(self.n > 0, self.mean + gap * share, other.mean)
        return CoMoments(
            np.stack([n, mean, self.joint + other.joint + gap * gap.T * weight, self.own + other.own + gap * gap * weight])
        )

    def correlations(self) -> list[list[float | None]]:
        """Pearson's r; None where one of the two does not vary."""
        with np.errstate(invalid="ignore", divide="ignore"):
            r = self.joint / (np.sqrt(self.own) * np.sqrt(self.own.T))
        np.fill_diagonal(r, 1.0)
        varies = (self.own > 0) & (self.own.T > 0)
        return [[float(v) if good else None for v, good in zip(*row)] for row in zip(r, varies)]

    def pack(self) -> bytes:
        return np.stack([self.n, self.mean, self.joint, self.own]).tobytes()

    @staticmethod
    def unpack(data: bytes, width: int) -> CoMoments:
        return CoMoments(np.frombuffer(data).reshape(4, width, width))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col_a, col_b, r) of all ordered pairs; each pair uses the rows where both are present."""
    columns, width = list(columns), len(columns)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = CoMoments.of(np.zeros((1, width)) * np.nan)
        for batch in batches:
            if batch.num_rows:
                total = total.merge(CoMoments.of(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)))
        yield pa.record_batch({"part": pa.array([total.pack()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> CoMoments:
        total = CoMoments.of(np.zeros((1, width)) * np.nan)
        for batch in batches:
            for part in batch.column("part").to_pylist():
                total = total.merge(CoMoments.unpack(part, width))
        return total

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"part": pa.array([merge(batches).pack()], pa.binary())})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = merge(batches).correlations()
        pairs = [(i, j) for i in range(width) for j in range(width)]
        yield pa.record_batch(
            {
                "col_a": pa.array([columns[i] for i, _ in pairs]),
                "col_b": pa.array([columns[j] for _, j in pairs]),
                "r": pa.array([r[i][j] for i, j in pairs], pa.float64()),
            }
        )

    # A null and a NaN are both missing.
    cells = df.select(*[F.ifnull(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"c{i}") for i, c in enumerate(columns)])
    parts = cells.mapInArrow(measure, "part binary").repartition(MERGERS)
    return parts.mapInArrow(together, "part binary").repartition(1).mapInArrow(finish, "col_a string, col_b string, r double")
