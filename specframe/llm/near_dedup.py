"""Near duplicates: improved consistent weighted sampling, banded, verified, joined into classes.

A document is its set of five-word shingles (words between white space, lower
case; all words where there are fewer than five), weighted by TF-IDF: the
shingle's count times an inverse document frequency that falls from 1 + ``RISE``
for the rarest to 1 for a shingle of every document.  (A steeper one would tell
copies of frequent texts apart by their few own, rare shingles.)  Document frequencies come from
one pass over all documents: each task adds up a sketch of ``SKETCH`` counters,
Spark adds the tasks' sketches, and the median counter, which is what
colliding shingles put into any counter, is taken off.  Relative to the number
of documents the sketch is as exact on a large corpus as on a small one.

Consistent weighted samples (``ROWS * BANDS`` of them) are drawn exactly: a
sample's smallest value can only come from shingles whose gamma variates bound
it from below, so those are tried first, and all others only where that bound
doesn't settle it.

Equal documents are one to begin with.  In every bucket of every band the
members first meet one leader each, the one they share most bands with.  A pair
that meets is verified by exact weighted Jaccard similarity (``SIMILARITY`` or
more) and linked, and linked documents form classes, by repeated minimum
labels.  Then, in buckets of several classes, all members of different classes
meet: a task has the vectors of a bucket, or of two of its ``BLOCK``s, and
returns no more links than join its classes.  A matrix product bounds from above
what each two members share; those that the bound and their total weights leave
are compared.  So every pair of a bucket is either in one
class or has been bounded or verified: no link is lost, near copies never make all their
pairs, and pairs that aren't similar never leave the task that compares them.

Texts without words are equal to each other.  Rows that repeat an id are
documents of their own if their texts differ.  A null id stays null, and a
class is named by its least id.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import DOC, TEXT, cut, fresh, map_arrow, mix64, partitions, shared_folder, slices, texts_of

SHINGLE, SIMILARITY, RISE, ROWS, BANDS, SKETCH, SAMPLES, SEED = 5, 0.8, 0.25, 5, 16, 1 << 18, 1 << 20, 11
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
#: Bytes of text that are looked at together.
PIECE = 3_000_000
#: Members of a bucket, and bytes of their vectors, beyond which it is compared block by block.
BLOCK, BLOCK_BYTES = 4000, 4_000_000
#: Members from which on bounds come before comparisons, shingles that have a column there, pairs bounded and members compared at once.
FEW, COLUMNS, CELLS, AT_ONCE = 24, 1024, 500_000, 64
_CACHE: dict = {}


def forget_memory() -> None:
    _CACHE.clear()


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _word_hashes(lists: list[list[str]], total: int) -> np.ndarray:
    """Python's hash of each word; Spark gives all its workers the same PYTHONHASHSEED."""
    return np.fromiter((h for words in lists for h in map(hash, words)), dtype=np.int64, count=total).view(np.uint64)


def shingles(lists: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text's words: the distinct shingles as 32-bit numbers, ascending, and their counts."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(sizes.sum())
    h = _word_hashes(lists, total)
    doc = np.repeat(np.arange(len(lists), dtype=np.uint64), sizes)
    none = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    keys = []
    with np.errstate(over="ignore"):
        if total >= SHINGLE:
            n = total - SHINGLE + 1
            out = h[:n] * _POWERS[0]
            for k in range(1, SHINGLE):
                out += h[k : n + k] * _POWERS[k]
            inside = doc[:n] == doc[SHINGLE - 1 :]
            keys.append((doc[:n] << np.uint64(32) | mix64(out) >> np.uint64(32))[inside])
        ends = np.cumsum(sizes)
        for k in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
            own = h[ends[k] - sizes[k] : ends[k]] * _POWERS[: sizes[k]]
            keys.append(np.array([k << 32 | int(mix64(own.sum(keepdims=True) + np.uint64(sizes[k]))[0]) >> 32], dtype=np.uint64))
    if not keys:
        return [none] * len(lists)
    key = np.sort(np.concatenate(keys))
    if not len(key):
        return [none] * len(lists)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key)))
    key = key[first]
    cuts = np.searchsorted(key, np.arange(len(lists) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
    s = key.astype(np.uint32)
    return [(s[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]


class Idf:
    """Inverse document frequencies from the summed sketch; one array of SKETCH counters."""

    def __init__(self, counts: np.ndarray, documents: int):
        n = max(1, documents)
        df = np.clip(counts - np.median(counts), 0, n)
        self.of = 1 + RISE * np.log((n + 1) / (df + 1)) / np.log(n + 1)

    def weights(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n * self.of[s & np.uint32(SKETCH - 1)]


def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c of SAMPLES pairs of Gamma(2, 1) variates, ordered by z = c e^-r, and ln z."""
    if "variates" not in _CACHE:
        rng = np.random.default_rng(SEED)
        r, c = rng.gamma(2, 1, SAMPLES), rng.gamma(2, 1, SAMPLES)
        z = np.log(c) - r
        at = np.argsort(z)
        _CACHE["variates"] = r[at], np.log(c)[at], z[at]
        k = np.random.default_rng(SEED + 1).integers(0, 1 << 63, (2, ROWS * BANDS), dtype=np.uint64)
        _CACHE["hashes"] = k[0] * np.uint64(2) + np.uint64(1), k[1]
    return _CACHE["variates"]


def _values(y: np.ndarray, log_s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a of Ioffe's scheme for hashes y and log-weights, and the quantised t."""
    rs, cs, _ = _variates()
    at = (y >> np.uint64(44)).astype(np.int64)
    r = rs[at]
    beta = ((y >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2.0**32
    t = np.floor(log_s / r + beta)
    return cs[at] - r * (t - beta) - r, t.astype(np.int64)


def signature(s: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The keys of the BANDS bands."""
    _, _, zs = _variates()
    mult, add = _CACHE["hashes"]
    n, total = len(s), ROWS * BANDS
    if not n:
        return np.zeros(BANDS, dtype=np.int64)
    wide = mix64(s.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    log_s = np.log(weights)
    most = float(log_s.max())
    # Enough of the smallest z for most minima to be settled by them.
    quantile = min(SAMPLES - 1, int(SAMPLES * min(1.0, 40 / n)))
    limit, bound = np.uint64(quantile << 44), zs[quantile] - most
    value = np.full(total, np.inf)
    best, level = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.int64)

    def lowest(rows: np.ndarray, row: np.ndarray, col: np.ndarray, y: np.ndarray) -> None:
        """The smallest value of each row, the first shingle among equals; ``row`` ascends."""
        a, t = _values(y, log_s[col])
        begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        least = np.minimum.reduceat(a, begin)
        at = np.flatnonzero(a == np.repeat(least, np.diff(np.append(begin, len(row)))))
        at = at[np.concatenate(([True], row[at][1:] != row[at][:-1]))]
        k = rows[row[at]]
        value[k], best[k], level[k] = a[at], wide[col[at]], t[at]

    step = max(1, 400_000 // n)
    for k in range(0, total, step):
        rows = np.arange(k, min(total, k + step))
        with np.errstate(over="ignore"):
            y = wide[None, :] ^ add[rows, None]
            y *= mult[rows, None]
        open_ = np.arange(len(rows))
        if quantile < SAMPLES - 1:
            flat = np.flatnonzero(y.ravel() < limit)
            if len(flat):
                row = flat // n
                lowest(rows, row, flat - row * n, y.ravel()[flat])
            open_ = np.flatnonzero(value[rows] > bound)
        if len(open_):
            row, col = np.repeat(np.arange(len(open_)), n), np.tile(np.arange(n), len(open_))
            lowest(rows[open_], row, col, y[open_].ravel())
    with np.errstate(over="ignore"):
        one = mix64(best ^ mix64(level.astype(np.uint64) + np.uint64(77))).reshape(BANDS, ROWS)
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + one[:, k])
    return key.view(np.int64)


def weighted_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, idf: Idf) -> float:
    """Of two lists of distinct ascending shingles and their counts."""
    both, x, y = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    wa, wb = idf.weights(a, na), idf.weights(b, nb)
    shared = np.minimum(wa[x], wb[y]).sum()
    whole = wa.sum() + wb.sum() - shared
    return float(shared / whole) if whole else 1.0


# -- document frequencies --------------------------------------------------------------------------------------------


def document_frequencies(docs: DataFrame) -> str:
    """The file of the summed sketch; its first number is how many documents have words."""
    path = os.path.join(shared_folder(docs.sparkSession, "document-frequencies"), "sketch")
    parts = 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros(SKETCH, dtype=np.int64), 0
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                for s, _ in shingles([words_of(t) for t in texts_of(piece.column(TEXT))]):
                    if len(s):
                        n += 1
                        np.add.at(sketch, s & np.uint32(SKETCH - 1), 1)
        if n:
            own = sketch.astype("<u4").reshape(parts, -1)
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(parts), pa.int32()), "n": [n] * parts, "counts": [x.tobytes() for x in own]})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype="<u4").astype(np.int64) for x in t.column("counts").to_pylist())
        return pa.table({"part": t.column("part")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": [total.astype("<i8").tobytes()]})

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros((parts, SKETCH // parts), dtype=np.int64), 0
        for batch in batches:
            for row in batch.to_pylist():
                out[row["part"]] = np.frombuffer(row["counts"], dtype="<i8")
                n = row["n"]
        own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
        np.concatenate(([n], out.ravel())).astype("<i8").tofile(own)
        os.replace(own, path)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    schema = "part int, n long, counts binary"
    counted = map_arrow(docs.select(F.col(TEXT)), count, schema)
    # First within salted groups, so that no task adds up more than its share of sketches.
    salted = counted.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("part", "salt").applyInArrow(lambda t: _add_narrow(t), schema)
    added = salted.groupBy("part").applyInArrow(add, schema)
    cut(map_arrow(added.coalesce(1), store, "n long"))
    if not os.path.exists(path):  # no document has words
        np.zeros(SKETCH + 1, dtype="<i8").tofile(path)
    return path


def _add_narrow(t: pa.Table) -> pa.Table:
    """Sums of sketches, in 32 bits still (64 tasks' shares of 2**32 / 64 documents each)."""
    total = sum(np.frombuffer(x, dtype="<u4").astype(np.int64) for x in t.column("counts").to_pylist())
    return pa.table({"part": t.column("part")[:1], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})


def _idf(path: str) -> Idf:
    if _CACHE.get("idf path") != path:
        raw = np.fromfile(path, dtype="<i8")
        _CACHE["idf path"], _CACHE["idf"] = path, Idf(raw[1:].astype(np.float64), int(raw[0]))
    return _CACHE["idf"]


# -- candidates ------------------------------------------------------------------------------------------------------


def _signatures(docs: DataFrame, sketch: str) -> DataFrame:
    """node (a 128-bit hash of the words), doc, th, bands of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = _idf(sketch)
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                lists = [words_of(t) for t in texts_of(piece.column(TEXT))]
                h = [xxhash.xxh3_128_digest(" ".join(words)) for words in lists]
                bands = [signature(s, idf.weights(s, n)) if len(s) else None for s, n in shingles(lists)]
                yield pa.RecordBatch.from_pydict({"node": pa.array(h, pa.binary()), "doc": piece.column("doc"), "th": piece.column("th"), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return map_arrow(_identified(docs), run, "node binary, doc long, th long, bands array<long>")


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(DOC).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(TEXT), F.lit(""))).alias("th"), F.col(TEXT))


def _vectors(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, v (distinct shingles and counts, as bytes) of the wanted documents."""
    path = bloom.build(wanted, F.xxhash64("doc", "th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                hit = bloom.may_contain(path, piece.column("key").to_numpy(zero_copy_only=False))
                own = piece.filter(pa.array(hit))
                v = []
                for s, n in shingles([words_of(t) for t in texts_of(own.column(TEXT))]):
                    many = np.flatnonzero(n > 1).astype("<u4")
                    v.append(b"".join((np.uint32(len(s)).tobytes(), s.astype("<u4").tobytes(), many.tobytes(), n[many].astype("<u4").tobytes())))
                yield pa.RecordBatch.from_pydict({"doc": own.column("doc"), "th": own.column("th"), "v": pa.array(v, pa.binary())})

    found = map_arrow(_identified(docs).withColumn("key", F.xxhash64("doc", "th")), run, "doc long, th long, v binary")
    same = F.col("w.doc").eqNullSafe(F.col("f.doc")) & (F.col("w.th") == F.col("f.th"))
    return found.dropDuplicates(["doc", "th"]).alias("f").join(wanted.alias("w"), same).select("w.node", "f.v")


def _vector(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(raw, dtype="<u4")
    k = int(x[0])
    n = np.ones(k, dtype=np.int64)
    rest = x[k + 1 :]
    if len(rest):
        n[rest[: len(rest) // 2]] = rest[len(rest) // 2 :]
    return x[1 : k + 1], n


def _verified(pairs: DataFrame, vectors: DataFrame, sketch: str, similarity: float) -> DataFrame:
    """a, b of the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = _idf(sketch)
        for batch in batches:
            keep = [weighted_jaccard(*_vector(x), *_vector(y), idf) >= similarity for x, y in zip(batch.column("va").to_pylist(), batch.column("vb").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    va = vectors.select(F.col("node").alias("a"), F.col("v").alias("va"))
    vb = vectors.select(F.col("node").alias("b"), F.col("v").alias("vb"))
    # A leader is in many pairs: it meets them while they are only names, and with its vector they then spread by the other one.
    return map_arrow(pairs.join(vb, "b").join(va, "a").select("a", "b", "va", "vb"), run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node, class: the least node of each linked set, by repeated minima over both ends and over labels."""
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("class")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        # A node takes its label's label, which halves the way to the least one.
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("further"))
        new = cut(lower.join(jump, "class", "left").select("node", "old", F.least(F.col("class"), F.coalesce("further", "class")).alias("class")))
        labels = new.select("node", "class")
        if new.where("class <> old").isEmpty():
            return labels


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels after some more links (a, b): only classes are joined, so the work is that of the new links."""
    links = cut(links)
    if links.isEmpty():
        return labels
    if labels is None:
        return components(links)
    ends = _labelled(links, labels).where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    over = components(ends).toDF("class", "to")
    nodes = labels.unionByName(links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").withColumn("class", F.col("node")))
    return cut(nodes.join(over, "class", "left").select("node", F.coalesce("to", "class").alias("class")))


def _labelled(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """pairs with ca and cb, the classes of a and b; a node without links is its own class."""
    if labels is None:
        return pairs.withColumn("ca", F.col("a")).withColumn("cb", F.col("b"))
    for x in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    return pairs


def _meetings(members: DataFrame, labels: DataFrame | None, vectors: DataFrame) -> DataFrame:
    """key, i, j, block, node, class, v: who meets whom in each bucket (key, node) of several classes.

    All of a bucket is block 0, or the members of its largest class, which
    needn't meet each other, are its first blocks and the others its last ones.
    In (i, j) the blocks i and j meet; each pair of members that may differ in
    class is in one of these.
    """
    sized = members.join(vectors.select("node", F.length("v").alias("size")), "node")
    if labels is None:
        classed = cut(sized.withColumn("class", F.col("node")))
    else:
        classed = cut(sized.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node")))
    sizes = classed.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = sizes.groupBy("key").agg(F.max_by(F.struct("class", "n", "size"), F.struct("n", "class")).alias("largest"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes")).where("classes > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / BLOCK, size / BLOCK_BYTES)).cast("int")

    whole = (F.col("n") <= BLOCK) & (F.col("size") <= BLOCK_BYTES)
    first = F.when(whole, 0).otherwise(blocks(F.col("largest.n"), F.col("largest.size")))
    rest = F.when(whole, 1).otherwise(blocks(F.col("n") - F.col("largest.n"), F.col("size") - F.col("largest.size")))
    cuts = mixed.select("key", F.col("largest.class").alias("largest"), first.alias("first"), rest.alias("rest"))
    in_first = (F.col("first") > 0) & (F.col("class") == F.col("largest"))
    own = F.when(in_first, F.pmod(F.xxhash64("node"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    placed = classed.join(cuts, "key").withColumn("block", own)
    # Those of the first blocks meet the last ones only.
    others = F.sequence(F.when(F.col("block") < F.col("first"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)
    met = placed.select("key", "node", "class", "block", F.explode(others).alias("other"))
    met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "class")
    return met.join(vectors, "node").select("key", "i", "j", "block", "node", "class", "v")


def join_classes(raw: list[bytes], classes: list[bytes], left: np.ndarray, right: np.ndarray, idf: Idf, similarity: float) -> list[tuple[int, int]]:
    """Links that join the classes of similar members; every pair of one of ``left`` with one of ``right`` is looked at, if their classes differ.

    ``raw`` has the members' vectors, ``left`` and ``right`` their numbers.
    """
    vectors = [_vector(x) for x in raw]
    # What all have, end to end; a shingle is its rank among all.
    sizes = np.array([len(s) for s, _ in vectors], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    known, rank, having = np.unique(np.concatenate([s for s, _ in vectors]), return_inverse=True, return_counts=True)
    rank, once = rank.astype(np.int32), idf.weights(known, np.ones(1, dtype=np.int64))
    weight = once[rank] * np.concatenate([n for _, n in vectors])
    total = np.add.reduceat(weight, starts)
    of = {c: k for k, c in enumerate(dict.fromkeys(classes))}
    own = np.array([of[c] for c in classes], dtype=np.int64)
    links = []
    dense = np.zeros(len(known))
    step = max(1, CELLS // len(left))
    bound = _bounds(rank, having, once, weight, starts, sizes) if len(left) >= FEW else None
    for k in range(0, len(right), step):
        rows = right[k : k + step]
        # Similar vectors are also similar in total weight.
        most = np.minimum(total[rows, None], total[None, left])
        if bound:
            most = np.minimum(most, bound(rows, left))
        may = most * (1 + similarity) >= similarity * (1 - 1e-4) * (total[rows, None] + total[None, left])
        may &= own[rows, None] != own[None, left]
        for r in np.flatnonzero(may.any(axis=1)).tolist():
            x = int(rows[r])
            at = np.flatnonzero(may[r])
            others = left[at[np.argsort(-most[r, at], kind="stable")]]
            entries = slice(starts[x], starts[x] + sizes[x])
            dense[rank[entries]] = weight[entries]
            # The likeliest first: a link may spare all others of that class.
            while len(others := others[own[others] != own[x]]):
                some, others = others[:AT_ONCE], others[AT_ONCE:]
                ends = np.cumsum(sizes[some])
                span = np.arange(ends[-1]) + np.repeat(starts[some] - (ends - sizes[some]), sizes[some])
                shared = np.add.reduceat(np.minimum(dense[rank[span]], weight[span]), ends - sizes[some])
                # Sums in another order may differ in the last places, so the last word is the plain function's.
                for y in some[shared >= similarity * (1 - 1e-9) * (total[some] + total[x] - shared)].tolist():
                    if own[y] != own[x] and weighted_jaccard(*vectors[x], *vectors[y], idf) >= similarity:
                        links.append((x, y))
                        own[own == own[y]] = own[x]
            dense[rank[entries]] = 0
    return links


def _bounds(rank: np.ndarray, having: np.ndarray, once: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of two lists of members: at most how much weight each two of them share.

    The shingles that most members have are columns of a matrix, and its
    product with itself is what two members share of these, once each.  Of the
    rest (rarer ones that others have too, and repeats) two share no more than
    the one with less of it has.
    """
    columns = np.flatnonzero(having > 1)
    if len(columns) > COLUMNS:
        columns = columns[np.argpartition(having[columns], -COLUMNS)[-COLUMNS:]]
    column = np.full(len(having), -1, dtype=np.int32)
    column[columns] = np.arange(len(columns))
    at = column[rank]
    inside = np.flatnonzero(at >= 0)
    rest = np.where(having[rank] > 1, weight, 0)
    rest[inside] -= once[rank[inside]]
    rest = np.add.reduceat(rest, starts)
    root = np.zeros((len(sizes), len(columns)), dtype=np.float32)
    root[np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[inside], at[inside]] = np.sqrt(once)[rank[inside]]
    # What is rounded off is less than the ten thousandth that the comparison allows.
    return lambda a, b: root[a] @ root[b].T + np.minimum(rest[a, None], rest[None, b])


def _joined(meetings: DataFrame, sketch: str, similarity: float) -> DataFrame:
    """a, b: the links that join the classes of those who meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = _idf(sketch)
        for t in _groups(batches, ("key", "i", "j")):
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            nodes, classes, raw = (t.column(k).to_pylist() for k in ("node", "class", "v"))
            if i == j:
                largest = Counter(classes).most_common(1)[0][0]
                left, right = np.arange(len(raw)), np.flatnonzero([c != largest for c in classes])
            else:
                block = t.column("block").to_numpy()
                left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            if len(left) and len(right):
                links = join_classes(raw, classes, left, right, idf, similarity)
                yield pa.RecordBatch.from_pydict({k: pa.array([nodes[x[n]] for x in links], pa.binary()) for n, k in enumerate("ab")})

    return map_arrow(meetings.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a binary, b binary")


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows that agree in some columns of integers, whatever batches they come in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if (now := tuple(k[:, a])) != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame | None]:
    """(node, doc, th of every document), (node, class of every linked node)."""
    sketch = document_frequencies(docs)
    raw = cut(_signatures(docs, sketch))
    nodes = raw.groupBy("node").agg(F.min(F.struct("doc", "th")).alias("rep"), F.min_by("bands", F.struct("doc", "th")).alias("bands")).where("bands is not null")
    keyed = nodes.select("node", "rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = cut(keyed.join(shared, "key"))
    wanted = members.groupBy("node").agg(F.first("rep").alias("rep")).select("node", "rep.doc", "rep.th")
    vectors = cut(_vectors(docs, wanted))
    members = members.select("key", "node")
    # Each member's leader of the most bands first; of the others only what these don't join is compared.
    least = members.groupBy("key").agg(F.min("node").alias("b"))
    most = members.join(least, "key").where("node <> b").groupBy(F.col("node").alias("a"), "b").count().groupBy("a").agg(F.max_by("b", F.struct("count", "b")).alias("b"))
    labels = _merged(None, _verified(most, vectors, sketch, similarity))
    labels = _merged(labels, _joined(_meetings(members, labels, vectors), sketch, similarity))
    return raw.select("node", "doc", "th"), labels


def _told(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with a table that has each key once, and in ``n`` how many of the ``total`` rows have it.

    Keys of so many rows that they would weigh on one task are at most four for
    each partition: they go to every task, and only the other rows are shuffled.
    """
    most = total // (4 * partitions(rows.sparkSession)) + 1
    hot, cold = table.where(F.col(n) > most).drop(n), table.where(F.col(n) <= most).drop(n)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def _classed(ids: DataFrame, labels: DataFrame | None) -> DataFrame:
    """node, first (the least doc and hash of its texts), n and class of each node."""
    nodes = ids.groupBy("node").agg(F.min(F.struct("doc", "th")).alias("first"), F.min("doc").alias("least"), F.count("*").alias("n"))
    if labels is None:
        return nodes.withColumn("class", F.col("node"))
    return nodes.join(labels, "node", "left").withColumn("class", F.coalesce("class", "node"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least id of its class) and class_size, for every document."""
    ids, labels = _classes(docs, similarity)
    nodes = cut(_classed(ids, labels).select("node", "least", "n", "class"))
    classes = nodes.groupBy("class").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_nodes"))
    of_node = cut(_told(nodes.select("node", "n", "class"), cut(classes), "class", "n_nodes", nodes.count()).drop("class"))
    return _told(ids.select("node", F.col("doc").alias(DOC)), of_node, "node", "n", ids.count()).select(DOC, "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the first by id and hash of the text, with all its columns.

    Of rows that agree in id and text one stays as well.
    """
    ids, labels = _classes(docs, similarity)
    doc, th = fresh(docs, "doc", "th")
    kept = _classed(ids, labels).groupBy("class").agg(F.min("first").alias("k")).select(F.col("k.doc").alias(doc), F.col("k.th").alias(th))
    # The least long stands for a null id, so that both steps below use one shuffle.
    null = F.lit(-(1 << 63))
    own = docs.withColumn(doc, F.coalesce(F.col(DOC).cast("long"), null)).withColumn(th, F.xxhash64(F.coalesce(F.col(TEXT), F.lit(""))))
    kept = kept.withColumn(doc, F.coalesce(doc, null))
    return own.join(kept, [doc, th], "left_semi").dropDuplicates([doc, th]).select(*[F.col(f"`{c}`") for c in docs.columns])
