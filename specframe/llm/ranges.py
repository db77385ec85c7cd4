"""Counts of hashed keys that grow with the corpus, in sorted files that workers map.

Workers add up what they count, cut it by ranges of the 63-bit key and send one
packed row for each range.  What comes together is added up and stored, sorted,
in files of its range; a task that runs twice leaves one whole file.  A range
holds about as much as any other, since keys are hashes, and a hot key is one
entry of each task's.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, shared_folder

#: Ranges whose files a worker holds open at once.
MOST_OPEN = 1000
#: Counts below this are stored in a byte.
_BYTE = 255


SUMS = (np.add, np.add)
#: The least and the greatest instead of sums.
SPAN = (np.minimum, np.maximum)


def added(keys: np.ndarray, n: np.ndarray, t: np.ndarray, how: tuple = SUMS) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their counts."""
    at = np.argsort(keys, kind="stable")
    keys = keys[at]
    if not len(keys):
        return keys, n, t
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], how[0].reduceat(n[at], first), how[1].reduceat(t[at], first)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The range that a 63-bit key lies in."""
    return ((keys >> np.uint64(39)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)


PACKED = "part int, keys binary, n binary, t binary"


class Adder:
    """Counts of keys over what a task reads, packed by ranges whenever there are many."""

    def __init__(self, parts: int, how: tuple = SUMS, most: int = 3_000_000):
        self.parts, self.how, self.most, self.held = parts, how, most, []

    def add(self, keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(added(keys, n, t, self.how))
        if sum(len(x[0]) for x in self.held) > self.most:
            self.held = [added(*map(np.concatenate, zip(*self.held)), self.how)]
            if len(self.held[0][0]) > self.most * 2 // 3:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            keys, n, t = added(*map(np.concatenate, zip(*self.held)), self.how)
            self.held = []
            yield from by_range(keys, self.parts, {"keys": keys, "n": n.astype("<u4"), "t": t.astype("<u4")})


class Mapped:
    """Columns in mapped files, one set for each range, sorted by the column ``keys``."""

    names: tuple[str, ...] = ("keys",)

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts = folder, parts
        self.maps: dict[int, dict[str, np.ndarray] | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"maps": {}}  # what is mapped stays where it is

    def _open(self, part: int) -> dict[str, np.ndarray] | None:
        if part not in self.maps:
            if len(self.maps) >= MOST_OPEN:
                self.maps.clear()
            paths = {x: os.path.join(self.folder, f"{x}-{part}.npy") for x in self.names}
            self.maps[part] = {k: np.load(v, mmap_mode="r") for k, v in paths.items()} if os.path.exists(paths["keys"]) else None
        return self.maps[part]

    def rows(self, wanted: np.ndarray) -> Iterator[tuple[slice, dict[str, np.ndarray], np.ndarray, np.ndarray]]:
        """For ascending keys, range by range: which of them, the range's columns, the row of each, and whether it has that key."""
        edges = np.searchsorted(part_of(wanted, self.parts), np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)).tolist():
            if (own := self._open(p)) is None or not len(own["keys"]):
                continue
            at = slice(edges[p], edges[p + 1])
            row = np.minimum(np.searchsorted(own["keys"], wanted[at]), len(own["keys"]) - 1)
            yield at, own, row, own["keys"][row] == wanted[at]

    def save(self, part: int, attempt: int, arrays: dict[str, np.ndarray]) -> None:
        """The keys last: they say that the others are there."""
        for name in (*self.names[1:], "keys"):
            mine = os.path.join(self.folder, f"{name}-{part}.{attempt}.npy")
            np.save(mine, arrays[name])
            os.replace(mine, os.path.join(self.folder, f"{name}-{part}.npy"))


class Sorted(Mapped):
    """Distinct keys and two counts of each."""

    names = ("keys", "n", "t", "large", "large_n", "large_t")

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For ascending keys: which are there, and their counts (0 where there are none)."""
        there, n, t = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=np.int64)
        for at, own, row, hit in self.rows(wanted):
            there[at] = hit
            n[at], t[at] = np.where(hit, own["n"][row], 0), np.where(hit, own["t"][row], 0)
            if len(own["large"]):
                k = np.minimum(np.searchsorted(own["large"], row), len(own["large"]) - 1)
                large = hit & (own["large"][k] == row)
                n[at], t[at] = np.where(large, own["large_n"][k], n[at]), np.where(large, own["large_t"][k], t[at])
        return there, n, t


def by_range(keys: np.ndarray, parts: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Ascending keys and what belongs to them as packed rows, one for each range."""
    edges = np.searchsorted(part_of(keys, parts), np.arange(parts + 1))
    own = np.flatnonzero(np.diff(edges))
    cuts = [(edges[p], edges[p + 1]) for p in own]
    for k in range(0, len(own), 64):
        yield pa.RecordBatch.from_pydict({"part": pa.array(own[k : k + 64], pa.int32())} | {name: pa.array([x[a:b].tobytes() for a, b in cuts[k : k + 64]], pa.binary()) for name, x in columns.items()})


def of_range(batches: Iterator[pa.RecordBatch], part: int, parts: int, types: dict[str, str]) -> dict[str, np.ndarray] | None:
    """What came together in a range; the first column holds the keys."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held += list(zip(*([np.frombuffer(x, dtype=kind) for x in batch.column(name).to_pylist()] for name, kind in types.items())))
    if not held:
        return None
    out = {name: np.concatenate(x) for name, x in zip(types, zip(*held))}
    if (part_of(next(iter(out.values())), parts) != part).any():
        raise RuntimeError("rows aren't in the partition of their range")
    return out


def store(packed: DataFrame, what: str, parts: int, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], how: tuple = SUMS) -> tuple[Sorted, list[int]]:
    """Add up packed counts, store those to ``keep``, and return them with: keys stored, their counts, and the counts of all.

    Of what isn't summed the keys alone are stored.
    """
    out = Sorted(shared_folder(packed.sparkSession, what), parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        own = of_range(batches, part, parts, {"keys": "<u8", "n": "<u4", "t": "<u4"})
        if own is None:
            return
        keys, n, t = own.values()
        keys, n, t = added(keys, n.astype(np.int64), t.astype(np.int64), how)
        own = keep(keys, n, t)
        told = [int(own.sum()), int(n[own].sum()), int(t[own].sum()), int(n.sum()), int(t.sum())]
        keys, n, t = keys[own], n[own], t[own]
        if how is not SUMS:
            n = t = np.zeros(len(keys), dtype=np.int64)
        large = np.flatnonzero(n >= _BYTE)
        out.save(part, task.taskAttemptId(), {"n": np.minimum(n, _BYTE).astype(np.uint8), "t": np.minimum(t, _BYTE).astype(np.uint8), "large": large, "large_n": n[large], "large_t": t[large], "keys": keys})
        yield pa.RecordBatch.from_pydict({f"s{k}": pa.array([v], pa.int64()) for k, v in enumerate(told)})

    names = [f"s{k}" for k in range(5)]
    told = cut(map_arrow(packed.repartitionById(parts, F.col("part")), run, ", ".join(f"{x} long" for x in names)))
    return out, [x or 0 for x in told.agg(*(F.sum(x).alias(x) for x in names)).first()]
