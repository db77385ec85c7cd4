"""Benchmark decontamination by SimHash over item-sized windows.

Each window of a document that is as long as a benchmark item gets a 64-bit
SimHash of its weighted word shingles.  Fingerprints are cut into the blocks of
``WIDTHS`` bits; if two differ in at most ``RADIUS`` bits, then in some block
they differ in at most ``RADIUS // len(WIDTHS)``.  Each item is listed, for its
number of words and each block, under all values that near its own, so one
look-up a block finds every item of the window's size within the radius.  The
items found are verified by the weighted Jaccard similarity of the shingles
(five words, ``SIMILARITY`` or more).  Weights rise with a shingle's rarity in
the benchmark, from 1 to 2.  Of pairs with a similarity of just 0.8 about one in
3,000 lies outside the radius, of greater ones fewer.

A window that shares no shingle with any item of its length has similarity 0,
so only windows around a shared shingle are fingerprinted: the others couldn't
pass the verification.

Tasks build the index, in parts of about ``MOST_ITEMS`` items, and store it as
files that workers map; the frequencies behind the weights are those of the
whole benchmark, so the number of parts changes no result.  Nothing of the
benchmark comes to the driver but its size.  An item of fewer than five words is
one shingle; one without words (or null) matches nothing.  A document shorter
than an item is compared as a whole.  Null and empty documents are clean.  Items
that repeat an id are all looked for.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import DOC, TEXT, cut, map_arrow, mix64, release, shared_folder, slices, texts_of, trim, word_codes
from .ranges import PACKED, Adder, Sorted, store

SHINGLE, SIMILARITY, RADIUS, MOST_ITEMS = 5, 0.8, 19, 20_000
WIDTHS = (13, 13, 13, 13, 12)
BITS = sum(WIDTHS)
#: Pairs of a window and an item that are held at once.
PAIRS = 1 << 20
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def runs(h: np.ndarray, width: int) -> np.ndarray:
    """A 63-bit hash of each run of so many words."""
    n = len(h)
    with np.errstate(over="ignore"):
        out = np.full(n - width + 1, width, dtype=np.uint64)
        for k in range(width):
            out += mix64(h[k : n - width + 1 + k] ^ _POWERS[k])
    return mix64(out) >> np.uint64(1)


def shingles(h: np.ndarray) -> np.ndarray:
    """The hash of each run of five words; of all words where there are fewer."""
    return runs(h, min(SHINGLE, len(h))) if len(h) else np.zeros(0, dtype=np.uint64)


def fingerprints(s: np.ndarray, starts: np.ndarray, count: int, frequencies: Frequencies) -> np.ndarray:
    """SimHash of the ``count`` shingles from each start on."""
    distinct, back = np.unique(s, return_inverse=True)
    bits = np.unpackbits(mix64(distinct).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
    weighted = (bits * frequencies.weights(distinct)[:, None])[back]
    sums = np.zeros((len(s) + 1, BITS), dtype=np.float64)
    np.cumsum(weighted, axis=0, out=sums[1:])
    windows = sums[starts + count] - sums[starts] > 0
    return np.packbits(windows, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def shingles_of(text: str | None) -> tuple[int, np.ndarray]:
    words = (text or "").lower().split()
    return len(words), shingles(word_hashes(words))


class Frequencies:
    """In how many of the benchmark's items each shingle is."""

    def __init__(self, items: int, counts: Counter | Sorted):
        self.items, self.counts = items, counts

    def weights(self, s: np.ndarray) -> np.ndarray:
        """Of ascending shingles."""
        if isinstance(self.counts, Counter):
            df = np.array([self.counts.get(x, 0) for x in s.tolist()], dtype=np.int64)
        else:
            df = self.counts.find(s)[1]
        return 1 + np.log((self.items + 1) / (df + 1)) / np.log(self.items + 2)


def _near_masks(width: int, bits: int) -> np.ndarray:
    return np.array([sum(1 << k for k in own) for n in range(bits + 1) for own in combinations(range(width), n)], dtype=np.uint64)


def _first_bit(block: int) -> int:
    return sum(WIDTHS[:block])


def _listing(sizes: np.ndarray, block: int, values: np.ndarray) -> np.ndarray:
    """What an item is listed under: its words, the block, and the block's value."""
    return sizes.astype(np.uint64) << np.uint64(16) | np.uint64(block << 13) | values


class Index:
    """What workers look windows up in: arrays, which may be mapped files."""

    def __init__(self, arrays: dict[str, np.ndarray], frequencies: Frequencies, radius: int = RADIUS, similarity: float = SIMILARITY):
        self.frequencies, self.radius, self.similarity = frequencies, radius, similarity
        self.ids, self.sizes, self.ends, self.items, self.prints = (arrays[x] for x in ("ids", "sizes", "ends", "items", "prints"))
        self.keys, self.key_ends, self.key_sizes = (arrays[x] for x in ("keys", "key_ends", "key_sizes"))
        self.listed, self.listed_ends, self.listed_items = (arrays[x] for x in ("listed", "listed_ends", "listed_items"))
        self.bitmap = np.zeros(1 << 20, dtype=bool)
        self.bitmap[(self.keys >> np.uint64(43)).astype(np.int64)] = True
        self.small = [x for x in np.unique(self.sizes).tolist() if x < SHINGLE]
        #: Windows looked up, and items compared with them by fingerprint.
        self.windows = self.tried = 0

    @classmethod
    def build(cls, items: list[tuple[int, str | None]], radius: int = RADIUS, similarity: float = SIMILARITY, frequencies: Frequencies | None = None) -> Index:
        """Of these items, by the frequencies of the whole benchmark, or as if they were all of it."""
        found = [(item, *shingles_of(text)) for item, text in items]
        found = [x for x in found if x[1]]
        if frequencies is None:
            frequencies = Frequencies(len(found), Counter(s for _, _, own in found for s in np.unique(own).tolist()))
        sizes = np.array([n for _, n, _ in found], dtype=np.int64)
        flat = np.concatenate([own for *_, own in found]) if found else np.zeros(0, dtype=np.uint64)
        lengths = np.array([len(own) for *_, own in found], dtype=np.int64)
        both = np.unique(np.stack([flat, np.repeat(sizes, lengths).astype(np.uint64)]), axis=1) if found else np.zeros((2, 0), dtype=np.uint64)
        keys, n = np.unique(both[0], return_counts=True)
        arrays = {
            "ids": np.array([item for item, *_ in found], dtype=np.int64), "sizes": sizes, "ends": np.concatenate(([0], np.cumsum(lengths))), "items": flat,
            "keys": keys, "key_ends": np.concatenate(([0], np.cumsum(n))), "key_sizes": both[1].astype(np.int64),
            "prints": np.array([fingerprints(own, np.array([0]), len(own), frequencies)[0] for *_, own in found], dtype=np.uint64),
        }
        under, listed = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for b, width in enumerate(WIDTHS):
            own = arrays["prints"] >> np.uint64(_first_bit(b)) & np.uint64((1 << width) - 1)
            for mask in _near_masks(width, radius // len(WIDTHS)):
                under.append(_listing(sizes, b, own ^ mask))
                listed.append(np.arange(len(found)))
        under, listed = np.concatenate(under), np.concatenate(listed)
        at = np.argsort(under, kind="stable")
        values, n = np.unique(under[at], return_counts=True)
        arrays |= {"listed": values, "listed_ends": np.concatenate(([0], np.cumsum(n))), "listed_items": listed[at].astype(np.int32)}
        index = cls(arrays, frequencies, radius, similarity)
        index.arrays = arrays
        return index

    def within_radius(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a window's fingerprint and an item of its size at most ``radius`` bits apart."""
        self.windows += len(prints)
        found = [np.zeros(0, dtype=np.int64)]
        for b, width in enumerate(WIDTHS):
            if not len(self.listed):
                break
            wanted = _listing(np.array([size]), b, prints >> np.uint64(_first_bit(b)) & np.uint64((1 << width) - 1))
            at = np.minimum(np.searchsorted(self.listed, wanted), len(self.listed) - 1)
            n = np.where(self.listed[at] == wanted, self.listed_ends[at + 1] - self.listed_ends[at], 0)
            ends = np.cumsum(n)
            first = 0
            while first < len(prints):
                base = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, base + PAIRS, side="right")))
                own = slice(first, last)
                row = np.repeat(np.arange(first, last), n[own])
                place = np.arange(len(row)) - np.repeat(ends[own] - n[own] - base, n[own]) + np.repeat(self.listed_ends[at[own]], n[own])
                item = self.listed_items[place].astype(np.int64)
                self.tried += len(item)
                keep = np.bitwise_count(prints[row] ^ self.prints[item]) <= self.radius
                found.append(row[keep] * len(self.ids) + item[keep])
                first = last
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def jaccard(self, a: np.ndarray, b: np.ndarray) -> float:
        """Weighted, of two multisets of shingles."""
        keys, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        x = np.bincount(back[: len(a)], minlength=len(keys))
        y = np.bincount(back[len(a) :], minlength=len(keys))
        w = self.frequencies.weights(keys)
        return float((np.minimum(x, y) * w).sum() / (np.maximum(x, y) * w).sum())

    def search(self, h: np.ndarray, s: np.ndarray) -> dict[int, float]:
        """Item number -> greatest similarity, of the items found in a document of these words and shingles."""
        out: dict[int, float] = {}
        if not len(s) or not len(self.keys):
            return out
        hits = np.flatnonzero(self.bitmap[(s >> np.uint64(43)).astype(np.int64)])
        short: dict[int, np.ndarray] = {}
        at = np.minimum(np.searchsorted(self.keys, s[hits]), len(self.keys) - 1)
        real = self.keys[at] == s[hits]
        spots: dict[int, list[int]] = defaultdict(list)
        for i, k in zip(hits[real].tolist(), at[real].tolist()):
            for size in self.key_sizes[self.key_ends[k] : self.key_ends[k + 1]].tolist():
                spots[size].append(i)
        for size in self.small:
            if size > len(h):
                continue
            # Items of fewer than five words: their one shingle is as long as they are.
            short[size] = runs(h, size)
            spots[size] = np.flatnonzero(np.isin(short[size], self.keys)).tolist()
        for size, where in spots.items():
            if not where:
                continue
            own = short.get(size, s)
            count = min(max(1, size - SHINGLE + 1), len(own))
            i = np.array(where)
            last = len(own) - count
            starts = np.unique(np.clip((i[:, None] - np.arange(count)[None, :]).ravel(), 0, last))
            low, high = int(starts[0]), int(starts[-1]) + count
            prints = fingerprints(own[low:high], starts - low, count, self.frequencies)
            for row, item in zip(*(x.tolist() for x in self.within_radius(prints, size))):
                sim = self.jaccard(own[starts[row] : starts[row] + count], self.items[self.ends[item] : self.ends[item + 1]])
                if sim >= self.similarity and sim > out.get(item, 0):
                    out[item] = sim
        return out


def search_texts(indexes: list[Index], texts: pa.Array) -> list[list[tuple[int, float]]]:
    """(item id, similarity) of the items found in each text.

    An item that repeats its id is found as often.
    """
    words, codes, sizes = word_codes(texts)
    h = word_hashes([w.lower() for w in words])[codes]
    ends = np.cumsum(sizes)
    # Shingles of all texts at once; those that run over the end of a text are cut off below.
    long = shingles(h) if len(h) >= SHINGLE else None
    out = []
    for n, end in zip(sizes.tolist(), ends.tolist()):
        own = h[end - n : end]
        s = long[end - n : end - SHINGLE + 1] if n >= SHINGLE else shingles(own)
        out.append([(int(x.ids[k]), v) for x in indexes for k, v in x.search(own, s).items()])
    return out


_INDEX: dict = {}


def forget_memory() -> None:
    _INDEX.clear()


def _place(folder: str, part: int, name: str) -> str:
    return os.path.join(folder, f"{name}-{part}.npy")


def _indexes(folder: str, parts: int, frequencies: Frequencies, similarity: float) -> list[Index]:
    """The parts' mapped files; a part without items has none."""
    if folder not in _INDEX:
        _INDEX.clear()
        _INDEX[folder] = []
        for part in range(parts):
            if os.path.exists(_place(folder, part, _ARRAYS[-1])):
                arrays = {x: np.load(_place(folder, part, x), mmap_mode="r") for x in _ARRAYS}
                _INDEX[folder].append(Index(arrays, frequencies, similarity=similarity))
    return _INDEX[folder]


_ARRAYS = ("ids", "sizes", "ends", "items", "prints", "keys", "key_ends", "key_sizes", "listed", "listed_ends", "listed_items")


def index(benchmark: DataFrame, most_items: int = MOST_ITEMS) -> tuple[str, int, Frequencies]:
    """Build the index of a benchmark (item_id, text): its folder, its parts, and the shingles' frequencies."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(TEXT)).where(F.length(F.trim(TEXT)) > 0)
    n = items.count()
    parts = max(1, -(-n // most_items))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts)
        for batch in batches:
            own = [np.unique(shingles_of(t)[1]) for t in texts_of(batch.column(TEXT))]
            keys = np.concatenate([np.zeros(0, dtype=np.uint64), *own])
            yield from adder.add(keys, np.ones(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
        yield from adder.flush()

    counts, _ = store(map_arrow(items, count, PACKED), "shingles", parts, lambda k, n, t: n > 0)
    frequencies, folder = Frequencies(n, counts), shared_folder(benchmark.sparkSession, "benchmark")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        rows = [x for b in batches for x in zip(b.column("item_id").to_pylist(), b.column(TEXT).to_pylist())]
        if not rows:
            return
        arrays = Index.build([(-1 if k is None else k, t) for k, t in rows], frequencies=frequencies).arrays
        for name in _ARRAYS:  # the last one says that all are there
            own = _place(folder, task.partitionId(), f"{name}.{task.taskAttemptId()}")
            np.save(own, arrays[name])
            os.replace(own, _place(folder, task.partitionId(), name))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    spread = items.repartitionById(parts, F.pmod(F.xxhash64("item_id", TEXT), F.lit(parts)).cast("int"))
    cut(map_arrow(spread, build, "n long"))
    return folder, parts, frequencies


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_items: int = MOST_ITEMS) -> DataFrame:
    """doc_id, contaminated, item_ids (sorted) and similarity, for every document."""
    docs = docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT))
    flagged = docs.select(DOC, _searched(docs, benchmark, similarity, most_items).alias("found"))
    return flagged.select(
        DOC,
        (F.size("found") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"]))).alias("item_ids"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["similarity"])), F.lit(0.0)).alias("similarity"),
    )


def _searched(docs: DataFrame, benchmark: DataFrame, similarity: float, most_items: int) -> Column:
    """(item_id, similarity) of each item found in a text."""
    importable(docs.sparkSession)
    folder, parts, frequencies = index(benchmark, most_items)

    @F.arrow_udf("array<struct<item_id: long, similarity: double>>")
    def found(text: pa.Array) -> pa.Array:
        release(__name__)
        indexes = _indexes(folder, parts, frequencies, similarity)
        out = []
        for piece in slices(pa.RecordBatch.from_arrays([text], [TEXT]), most=4_000_000):
            out += [[{"item_id": k, "similarity": v} for k, v in own] for own in search_texts(indexes, piece.column(TEXT))]
        trim()
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())])))

    return found(F.col(TEXT))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, most_items: int = MOST_ITEMS) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    return docs.where(F.size(_searched(docs, benchmark, similarity, most_items)) == 0)
