"""Bloom filters of fixed size, filled in tasks and sent to all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: log2 of a filter's bits; its hashes; bytes of a part in which it travels.
BITS, HASHES, PART = 27, 2, 1 << 16

_ODD = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _places(name: np.ndarray, k: int) -> np.ndarray:
    return ((name * _ODD[k]) >> np.uint64(64 - BITS)).astype(np.int64)


def among(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Which names, 64-bit hashes, the filter lets through."""
    some = np.ones(len(name), bool)
    for k in range(HASHES):
        h = _places(name, k)
        some &= (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)
    return some


def build(rows: DataFrame, names):
    """A broadcast Bloom filter of 2**BITS bits, however many rows, of the numbers that
    `names` makes of a task's batches, as arrays. Tasks fill one each, whose parts are put together."""

    def fill(batches):
        bits = np.zeros(1 << (BITS - 3), np.uint8)
        for name in names(batches):
            for k in range(HASHES if len(name) else 0):
                h = np.sort(_places(name, k))
                at = np.flatnonzero(np.append(True, h[1:] >> 3 != h[:-1] >> 3))
                bits[h[at] >> 3] |= np.bitwise_or.reduceat(np.left_shift(1, h & 7).astype(np.uint8), at)
        parts = bits.reshape(-1, PART)
        yield parted({int(k): parts[k] for k in np.flatnonzero(parts.any(axis=1))})

    def merge(batches):
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = np.frombuffer(some, np.uint8)
                parts[k] = parts[k] | some if k in parts else some
        yield parted(parts)

    def parted(parts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())],
            names=["part", "bits"],
        )

    schema = "part int, bits binary"
    bits = np.zeros(1 << (BITS - 3), np.uint8).reshape(-1, PART)
    for r in rows.mapInArrow(fill, schema).repartition("part").mapInArrow(merge, schema).collect():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
    return rows.sparkSession.sparkContext.broadcast(bits.reshape(-1))


def of_column(rows: DataFrame, column: str):
    """Whether a Column may be in `column` of `rows`, as a function: never wrong where it says no."""

    def names(batches):
        for batch in batches:
            yield np.asarray(batch.column(0)).view(np.uint64)

    there = build(rows.select(F.xxhash64(column).alias("name")), names)

    @F.pandas_udf("boolean")
    def may(name):
        return type(name)(among(there.value, name.to_numpy().view(np.uint64)))

    def test(value: Column) -> Column:
        return may(F.xxhash64(value))

    return test
