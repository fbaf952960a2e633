"""Distributed sums and parameter averages for the small trained models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Partitions of a bounded training sample: bounds what one step sends to the driver.
PARTS = 12


def labelled_sample(labels: DataFrame, label_col: str, id_col: str, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` labelled ids (``id``, ``y``), chosen by a keyed hash; small enough to broadcast by its bound.

    All of them if they are fewer; else a share that is expected to fill nine tenths of the bound.
    """
    s = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    total = s.count()
    if total > rows:
        share = int(0.9 * rows / total * (1 << 32))
        s = s.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) < share)
    return s.limit(rows)


def sum_vectors(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """Sum over partitions of one vector each; ``df`` must have a bounded number of partitions."""
    def run(batches):
        v = fn(batches)
        if v is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(v, np.float64).tobytes()])], names=["v"])
    parts = [np.frombuffer(r[0]) for r in df.mapInArrow(run, "v binary").collect()]
    return np.sum(parts, axis=0) if parts else None


class Adam:
    """Steps of the Adam rule on one flat vector."""

    def __init__(self, n: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(n), np.zeros(n), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        return -self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))
