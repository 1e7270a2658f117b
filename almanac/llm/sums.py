"""Sums of one fixed-size array over all tasks of a job."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Entries of the pieces that an array is shuffled in, and partial sums of a piece before its last.
PIECE, PARTS = 1 << 16, 64
SCHEMA = "piece int, part int, value binary"


def pieces(array: np.ndarray) -> pa.RecordBatch:
    """A task's array as rows of SCHEMA, for ``summed``; pieces of zeros only are left out."""
    flat, part = np.ascontiguousarray(array).ravel(), TaskContext.get().partitionId() % PARTS
    cut = [flat[k : k + PIECE] for k in range(0, len(flat), PIECE)]
    own = [(k, part, v.tobytes()) for k, v in enumerate(cut) if v.any()]
    columns = [pa.array([r[i] for r in own], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["piece", "part", "value"])


def summed(parts: DataFrame, shape: tuple[int, ...], dtype: type) -> np.ndarray:
    """The sum of the arrays of ``parts`` on the driver. A group is read one array at a time, so
    neither a task nor the driver holds more than one array of this shape and its pieces."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece, part = None, 0, 0
        for batch in batches:
            for k, p, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(value, dtype)
                total, piece, part = own.copy() if total is None else total + own, k, p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["piece", "part", "value"])

    out = np.zeros(int(np.prod(shape)), dtype)
    found = parts.groupBy("piece", "part").applyInArrow(add, SCHEMA).groupBy("piece").applyInArrow(add, SCHEMA).select("piece", "value")
    for batch in found.toArrow().to_batches():  # Arrow: neither JVM nor Python makes objects of the values
        for piece, value in zip(*batch.columns, strict=True):
            k = piece.as_py() * PIECE
            out[k : k + PIECE] = np.frombuffer(value.as_buffer(), dtype)
    return out.reshape(shape)
