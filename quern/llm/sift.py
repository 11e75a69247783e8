"""Picking the rows of a large table whose key is in a set, before anything is shuffled.

The set becomes a filter of bits whose size is bounded: rows that can't be in it
are told where they are read, by the key alone; the few others that pass by
chance are for an exact join to drop.  More keys only make the filter less sharp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix, settle

#: Bits for each key, and the powers of two between which the filter's size stays (16 MB at most).
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 16, 27
_SLICE = 20


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _dealt(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(batch.column(0).to_numpy(zero_copy_only=False), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> _SLICE).astype(np.int32)), pa.array((at & ((1 << _SLICE) - 1)).astype(np.int32))], names=["slice", "at"])

    return run


def _marked(table: pa.Table) -> pa.Table:
    held = np.zeros(1 << _SLICE, bool)
    held[table.column("at").to_numpy()] = True
    return pa.table({"slice": table.column("slice").slice(0, 1), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})


def key_filter(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """Packed bits for the keys (one column of longs that are not null), and the logarithm of how many bits there are."""
    bits = min(max(LEAST_BITS, (BITS_A_KEY * count).bit_length()), MOST_BITS)
    out = np.zeros(max(1 << bits, 1 << _SLICE), bool)
    dealt = keys.mapInArrow(_dealt(bits), "slice int, at int").distinct()
    for at, held in dealt.groupBy("slice").applyInArrow(_marked, "slice int, held binary").collect():
        out[at << _SLICE : (at + 1) << _SLICE] = np.unpackbits(np.frombuffer(bytes(held), np.uint8)).astype(bool)
    return np.packbits(out[: 1 << bits]), bits


def held_in(keys: np.ndarray, packed: np.ndarray, bits: int) -> np.ndarray:
    """Whether each key may be among those of a filter."""
    at = _places(keys, bits)
    return (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0


def may_hold(keys: DataFrame, key: Column, count: int) -> Column:
    """Whether a row's key (a long, not null) may be among `keys`: true for all that are."""
    packed, bits = key_filter(keys, count)
    shared = keys.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(held_in(batch.to_numpy(), shared.value, bits))
        settle()

    return run(key)
