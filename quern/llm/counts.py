"""Counts of hash buckets over a whole table: a vector from each task, added up in two levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets in a slice, and tasks whose vectors one task of the first level adds.
SLICE, GROUP = 1 << 14, 64


def packed(counts: np.ndarray) -> list[bytes]:
    """The slices of a vector of counts, each in the narrowest integers that hold it."""
    out = []
    for part in np.split(counts, max(1, len(counts) // SLICE)):
        most = int(part.max(initial=0))
        out.append(part.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max)).tobytes())
    return out


def _added(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py()
                part = np.frombuffer(data, f"u{len(data) // size}")
                held[at] = held[at] + part if at in held else part.astype(np.int64)
        for at, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed(total)[0]], pa.binary())], names=["slice", "counts"])

    return run


def summed(vectors: DataFrame, length: int) -> np.ndarray:
    """The sum of all tasks' vectors (slice, counts by packed()), `length` numbers on the driver; no task holds more than its slices' sums."""
    size = min(length, SLICE)
    kind = "slice int, counts binary"
    first = vectors.withColumn("g", F.floor(F.spark_partition_id() / GROUP)).repartition("slice", "g").select("slice", "counts").mapInArrow(_added(size), kind)
    out = np.zeros(length, np.int64)
    for at, data in first.repartition("slice").mapInArrow(_added(size), kind).collect():
        data = bytes(data)
        out[at * size : (at + 1) * size] = np.frombuffer(data, f"u{len(data) // size}")
    return out
