"""Bloom filters of a fixed size, made by Spark and mapped by workers.

They only thin out what is shuffled: whatever passes one is joined exactly
afterwards, so their size changes the cost, never a result.  Bits are set by an
aggregation over 64-bit words; a filter's file has 2**LOG2_BITS bits.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, mix64, shared_folder

LOG2_BITS = 28
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)


def _positions(keys: np.ndarray) -> list[np.ndarray]:
    shift = np.uint64(64 - LOG2_BITS)
    return [mix64(keys.astype(np.uint64) ^ np.uint64(s)) >> shift for s in _SEEDS]


def build(keys: DataFrame, key: Column) -> str:
    """The file of the filter of a column of longs."""
    path = os.path.join(shared_folder(keys.sparkSession, "bloom"), "bits")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate(_positions(k)) if len(k) else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_pydict({"word": pa.array((at >> np.uint64(6)).astype(np.int32)), "bits": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (LOG2_BITS - 6), dtype=np.uint64)
        n = 0
        for batch in batches:
            bits[batch.column(0).to_numpy(zero_copy_only=False)] = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            n += batch.num_rows
        own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        bits.tofile(own)
        os.replace(own, path)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    agg = map_arrow(keys.select(key.alias("key")), words, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    # At most 2**LOG2_BITS / 64 rows come together here, whatever the input.
    cut(map_arrow(agg.coalesce(1), store, "n long"))
    if not os.path.exists(path):  # no keys, so no task stored anything
        with open(path, "wb") as f:
            f.truncate((1 << LOG2_BITS) // 8)
    return path


_OPEN: dict[str, np.ndarray] = {}


def forget_memory() -> None:
    _OPEN.clear()


def may_contain(path: str, keys: np.ndarray) -> np.ndarray:
    if (bits := _OPEN.get(path)) is None:
        _OPEN.clear()
        bits = _OPEN[path] = np.memmap(path, dtype=np.uint64, mode="r")
    out = np.ones(len(keys), dtype=bool)
    for at in _positions(keys.view(np.uint64)):
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
    return out
