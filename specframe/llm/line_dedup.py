"""Line dedup: exact, and near by a deletion-neighbourhood join.

A line counts by its words (between white space).  Every line with a word is
compared exactly; blank lines are left alone.  Of equal lines the earliest
stays, by doc_id, hash of the text and number of the line.  A line of ``NEAR``
words or more also goes if an earlier line is within its edit bound, whether or
not that one stays itself.

The bound counts units: words in lines of up to ``WORDS`` words, in longer ones
phrases, which end after words whose hash is a multiple of 2 (of 4 beyond twice
as many words, and so on), so that no line has many more than ``WORDS`` units.  Near such a limit a line is looked at in both ways.  A line of ``TWO``
units or more may differ by two insertions, deletions or substitutions of a
unit, a shorter one by one, and so one of more than ``MANY`` units, as only lines
of the same few words have; below ``FEW`` units lines are compared exactly only.

Every line has variants: itself, itself without one unit, and, from ``TWO``
units on, without two.  Lines within the bound share a variant.  All variants
are emitted as hashed keys and lines with an equal key are joined: for each way
in which two lines that share a variant must be within the bound (the units left
out of both lie at the same places, or are two in all) the earliest line stands
for all others, so no pairs among the others are made.  Every pair is then
verified by its edit distance.

Before that the corpus is thinned, without loss.  Lines within two edits share
their first or last third, or the middle one, moved by a unit at most; only
lines that share such an anchor with a different line emit variants, and only
variants that occur twice are joined.  Anchors and variants lie in sorted files
that workers map.

Nulls and empty texts have no lines to drop.  Rows that agree in id and text
are decided as one document.  Hot lines are added up before each shuffle, and
occurrences of a line never meet: each looks up where the line is first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import DOC, TEXT, cut, fresh, map_arrow, mix64, partitions, release, shared_folder, slices, trim, word_codes, written
from .ranges import PACKED, SPAN, Adder, Mapped, Sorted, by_range, of_range, store

NEAR, WORDS, TWO, FEW, MANY, CUTS = 8, 32, 16, 6, 144, 2
#: Keys that a task adds up before it sends them.
HELD = 500_000
#: Bytes of text that are looked at together.
PIECE = 3_000_000
REF = "doc long, th long, line int"
NULL = -(1 << 63)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASES = (0xD1342543DE82EF95, 0xF1357AEA2E62A9C5)
#: Lengths of anchors; few, so that most lines of about the same length have the same.
_GRID = np.unique(np.concatenate((np.arange(1, 6), np.round(1.22 ** np.arange(9, 70))))).astype(np.int64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def forget_memory() -> None:
    _POWERS.clear()


# -- hashes of runs of units ---------------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        own = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, b, dtype=np.uint64)))) for b in (base, pow(base, -1, 1 << 64))]
        _POWERS[base] = own[0], own[1]
    return _POWERS[base]


class Runs:
    """Polynomial hashes of any runs of a sequence, from sums over its beginnings."""

    def __init__(self, h: np.ndarray, base: int = _BASES[0]):
        power, self.inverse = _powers(base, len(h) + 2)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * power[: len(h)])))

    def hash(self, a: np.ndarray, b: np.ndarray, *holes: np.ndarray) -> np.ndarray:
        """Of the run from a to b without the units at these places, ascending."""
        total, at, moved = np.zeros(len(a), dtype=np.uint64), a, 0
        for stop in (*holes, b):
            total += (self.sums[stop] - self.sums[at]) * self.inverse[moved]
            at, moved = stop + 1, moved + 1
        return mix64(total * self.inverse[a] + (b - a - len(holes)).astype(np.uint64) * _ODD)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of runs that begin at ``starts``, and the run of each."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), row


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word of all lines, where each line's words begin (and all end), and each line's text and number there."""
    lists = pc.split_pattern(pc.fill_null(column, ""), "\n")
    n = np.diff(lists.offsets.to_numpy().astype(np.int64))
    number, doc = _runs(np.zeros(len(n), dtype=np.int64), n)
    return *words_of(lists.flatten()), doc, number


def words_of(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words, codes, sizes = word_codes(lines)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    return h[codes], np.concatenate(([0], np.cumsum(sizes)))


# -- units, anchors and variants -------------------------------------------------------------------------------------------


def _level(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log(np.maximum(n / WORDS, 1)) / np.log(CUTS) - 1e-9).astype(np.int64)


class Units:
    """Lines of NEAR words or more as sequences of units: words, or phrases of a level."""

    def __init__(self, h: np.ndarray, ends: np.ndarray):
        n = np.diff(ends)
        own = np.flatnonzero(n >= NEAR)
        below, above = _level(n[own] * 0.92), _level(n[own] * 1.08)
        both = above != below
        #: The line of each sequence, and its level.
        self.line, self.level = np.concatenate((own, own[both])), np.concatenate((below, above[both]))
        words, row = _runs(ends[self.line], n[self.line])
        last = np.zeros(len(words), dtype=bool)
        last[np.cumsum(n[self.line]) - 1] = True
        stop = last | (mix64(h[words] + _ODD) & (np.uint64(CUTS) ** self.level.astype(np.uint64) - np.uint64(1))[row] == 0)
        at = np.flatnonzero(stop)
        # Every line's last word ends a unit, so the next unit begins where one ends.
        self.h = Runs(h[words]).hash(np.concatenate(([0], at[:-1] + 1))[: len(at)], at + 1)
        self.ends = np.concatenate(([0], np.cumsum(np.bincount(row[at], minlength=len(self.line)))))

    def few(self) -> np.ndarray:
        return np.diff(self.ends) < FEW


def anchors(h: np.ndarray, ends: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of which two sequences within two edits share one, and the sequence of each."""
    runs, u = Runs(h), np.diff(ends)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    done: list[np.ndarray] = []
    for less in range(3):
        third = _GRID[np.maximum(np.searchsorted(_GRID, np.maximum(u - less, 3) // 3, side="right") - 1, 0)]
        new = np.flatnonzero(np.all([third != x for x in done], axis=0) if done else np.ones(len(u), dtype=bool))
        done.append(third)
        w, a, b = third[new], ends[:-1][new], ends[1:][new]
        tag = mix64((level[new] << 32 | w).astype(np.uint64)) * np.uint64(4)
        middle = np.maximum(w - 1, 1)
        for kind, x, n in ((0, a, w), (1, b - w, w), (2, a + w, middle), (2, a + w + 1, middle)):
            inside = (x >= a) & (x + n <= b)
            out.append((mix64(runs.hash(x[inside], (x + n)[inside]) ^ (tag[inside] + np.uint64(kind))), new[inside]))
    return np.concatenate([x for x, _ in out]) >> np.uint64(1), np.concatenate([x for _, x in out])


def variants(h: np.ndarray, ends: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, sequence, units left out, and the places of these in what is left (-1 where there are none) of all variants."""
    runs, u, tag = Runs(h), np.diff(ends), mix64(level.astype(np.uint64) + _ODD)
    a, b, rows = ends[:-1], ends[1:], np.arange(len(u))
    none = np.full(len(u), -1)
    out = [(runs.hash(a, b), rows, np.zeros(len(u), dtype=np.int64), none, none)]
    p, row = _runs(a, u)
    out.append((runs.hash(a[row], b[row], p), row, np.ones(len(row), dtype=np.int64), p - a[row], np.full(len(row), -1)))
    # Pairs of places: after each place all later ones.
    long = np.where(two(u), u, 0)
    p, row = _runs(a, long)
    q, pair = _runs(p + 1, b[row] - p - 1)
    p, row = p[pair], row[pair]
    out.append((runs.hash(a[row], b[row], p, q), row, np.full(len(row), 2), p - a[row], q - a[row] - 1))
    v, row, left, p, q = (np.concatenate(x) for x in zip(*out))
    return mix64(v ^ tag[row]) >> np.uint64(1), row, left, p, q


def two(units: np.ndarray) -> np.ndarray:
    return (units >= TWO) & (units <= MANY)


def bound(units: int) -> int:
    return 0 if units < FEW else 1 + bool(two(units))


def within(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two sequences are at most so many edits apart, on a band of the table."""
    if abs(len(a) - len(b)) > most:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    end = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - end].tolist(), b[: len(b) - end].tolist()
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            new[j] = min(row.get(j, most) + 1, new.get(j - 1, most) + 1, row.get(j - 1, most + 1) + (j > 0 and x != b[j - 1])) if j else i
        row = new
        if min(row.values()) > most:
            return False
    return row.get(len(b), most + 1) <= most


# -- the join ----------------------------------------------------------------------------------------------------------------


def _identified(docs: DataFrame) -> DataFrame:
    d, h = F.coalesce(F.col(DOC).cast("long"), F.lit(NULL)), F.xxhash64(F.coalesce(F.col(TEXT), F.lit("")))
    return docs.select(d.alias("doc"), h.alias("th"), _key(d, h).alias("key"), F.col(TEXT))


def _key(doc: Column, th: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(doc, th), 1)


def _line_rows(docs: DataFrame) -> DataFrame:
    """Where each line with a word is, its 128-bit hash, and its anchors as bytes (null without)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                h, ends, doc, number = lines_of(piece.column(TEXT))
                some = np.flatnonzero(np.diff(ends))
                a, b = ends[:-1][some], ends[1:][some]
                h1, h2 = (Runs(h, base).hash(a, b).view(np.int64) for base in _BASES)
                units = Units(h, ends)
                keys, row = anchors(units.h, units.ends, units.level)
                keep = ~units.few()[row]
                keys, line = keys[keep], units.line[row[keep]]
                at = np.argsort(line, kind="stable")
                keys, line = keys[at], line[at]
                cuts = np.searchsorted(line, np.concatenate((some, some[-1:] + 1)))
                raw = keys.astype("<u8").tobytes()
                blobs = [raw[x * 8 : y * 8] or None for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                of = {n: piece.column(n).take(pa.array(doc[some])) for n in ("doc", "th", "key")}
                yield pa.RecordBatch.from_pydict({"h1": pa.array(h1), "h2": pa.array(h2)} | of | {"line": pa.array(number[some].astype(np.int32)), "anchors": pa.array(blobs, pa.binary())})

    return map_arrow(_identified(docs), run, "h1 long, h2 long, doc long, th long, key long, line int, anchors binary")


def _shared_anchors(rows: DataFrame, parts: int) -> Sorted:
    """Anchors of different lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts, SPAN, HELD)
        for batch in batches:
            raw = batch.column("anchors").to_pylist()
            keys = np.frombuffer(b"".join(raw), dtype="<u8")
            tag = np.repeat(batch.column("h1").to_numpy().view(np.uint64) & np.uint64(0xFFFFFFFF), [len(x) // 8 for x in raw]).astype(np.int64)
            yield from adder.add(keys, tag, tag)
        yield from adder.flush()

    return store(map_arrow(rows.where("anchors IS NOT NULL").select("h1", "anchors"), run, PACKED), "anchors", parts, lambda k, n, t: n != t, SPAN)[0]


def _there(of: Sorted, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``Sorted.find`` for keys in any order."""
    distinct, back = np.unique(keys, return_inverse=True)
    return tuple(x[back] for x in of.find(distinct))


def _wanted(rows: DataFrame, shared: Sorted, parts: int) -> Sorted:
    """The lines that have a shared anchor."""
    sent = rows.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts, most=HELD)
        for batch in batches:
            raw = batch.column("anchors").to_pylist()
            row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            hit = np.unique(row[_there(sent.value, np.frombuffer(b"".join(raw), dtype="<u8"))[0]])
            keys = _line_keys(batch.column("key").to_numpy()[hit], batch.column("line").to_numpy()[hit])
            yield from adder.add(keys, np.ones(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
        yield from adder.flush()

    return store(map_arrow(rows.where("anchors IS NOT NULL").select("key", "line", "anchors"), run, PACKED), "wanted-lines", parts, lambda k, n, t: n > 0)[0]


def _sequences(docs: DataFrame, shared: Sorted, wanted: Sorted) -> DataFrame:
    """The distinct lines with a shared anchor: hash, level, units as bytes, and where the line is first."""
    sent = docs.sparkSession.sparkContext.broadcast((shared, wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, wanted = sent.value
        for batch in batches:
            for piece in slices(batch, most=PIECE):
                lists = pc.split_pattern(pc.fill_null(piece.column(TEXT), ""), "\n")
                ends = lists.offsets.to_numpy().astype(np.int64)
                number, doc = _runs(np.zeros(len(ends) - 1, dtype=np.int64), np.diff(ends))
                own = np.flatnonzero(_there(wanted, _line_keys(piece.column("key").to_numpy()[doc], number))[0])
                number, doc = number[own], doc[own]
                h, ends = words_of(lists.flatten().take(pa.array(own)))
                units = Units(h, ends)
                keys, row = anchors(units.h, units.ends, units.level)
                own = np.zeros(len(units.line), dtype=bool)
                own[row[_there(shared, keys)[0]]] = True
                own = np.flatnonzero(own & ~units.few())
                line = units.line[own]
                h1, h2 = (Runs(h, base).hash(ends[:-1][line], ends[1:][line]).view(np.int64) for base in _BASES)
                raw = units.h.astype("<u8").tobytes()
                cuts = zip((units.ends[own] * 8).tolist(), (units.ends[own + 1] * 8).tolist())
                of = {n: piece.column(n).take(pa.array(doc[line])) for n in ("doc", "th")}
                yield pa.RecordBatch.from_pydict({"h1": pa.array(h1), "h2": pa.array(h2), "level": pa.array(units.level[own].astype(np.int32))} | of | {"line": pa.array(number[line].astype(np.int32)), "units": pa.array([raw[a:b] for a, b in cuts], pa.binary())})

    rows = map_arrow(_identified(docs), run, f"h1 long, h2 long, level int, {REF}, units binary")
    return rows.groupBy("h1", "h2", "level").agg(F.min(F.struct("doc", "th", "line")).alias("ref"), F.first("units").alias("units")).select("h1", "h2", "level", "ref.*", "units")


def _unpacked(batch: pa.RecordBatch, most: int = 500_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of sequences that have about so many variants, with their units and where these end."""
    sizes = np.array([len(x) // 8 for x in batch.column("units").to_pylist()], dtype=np.int64)
    ends = np.cumsum(sizes * sizes // 2 + sizes + 1)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        own = batch.slice(first, last - first)
        yield own, np.frombuffer(b"".join(own.column("units").to_pylist()), dtype="<u8").astype(np.uint64), np.concatenate(([0], np.cumsum(sizes[first:last])))
        first = last


def _repeated_variants(sequences: DataFrame, parts: int) -> Sorted:
    """Variants of two sequences or more: by how many that leave out one unit at most, and by how many that leave out two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts, most=HELD)
        for batch in batches:
            for own, h, ends in _unpacked(batch):
                v, row, left, _, _ = variants(h, ends, own.column("level").to_numpy())
                # A sequence with repeats has a variant in several ways, and counts once for it.
                at = np.lexsort((row, v))
                one = at[np.concatenate(([True], (v[at][1:] != v[at][:-1]) | (row[at][1:] != row[at][:-1])))]
                yield from adder.add(v[one], (left[one] < 2).astype(np.int64), (left[one] == 2).astype(np.int64))
        yield from adder.flush()

    return store(map_arrow(sequences.select("level", "units"), run, PACKED), "variants", parts, lambda k, n, t: n + t > 1)[0]


def links(v: np.ndarray, left: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray, t: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, ...]:
    """link, variant's number, leads, follows: all that lead a link are within the bound of all that follow it.

    n and t are how many leave out one unit at most, or two, for the variant;
    ``wide`` says whether the line's own bound is two.
    """
    out = []

    def add(kind: int, where: np.ndarray, leads: bool, follows: np.ndarray | bool, *place: np.ndarray) -> None:
        at = np.flatnonzero(where & (np.broadcast_to(follows, where.shape) | leads))
        key = v[at] * _ODD + np.uint64(kind)
        for x in place:
            key = mix64(key) + x[at].astype(np.uint64)
        out.append((mix64(key), at, np.full(len(at), leads), np.broadcast_to(follows, where.shape)[at]))

    whole, one, both = left == 0, left == 1, left == 2
    add(1, (left < 2) & (n > 1), True, wide)  # one unit left out of either, at any place
    add(2, whole & (n > 1), True, False)
    add(2, one & (n > 1), False, ~wide)
    add(3, one & (n > 1), True, False)
    add(3, whole & (n > 1), False, ~wide)
    add(4, one & (n > 1), True, ~wide, p)
    add(5, both & (t > 1), True, wide, p, q)
    add(6, whole & (t > 0), True, False)
    add(6, both & (n > 0), False, wide)
    add(7, both & (n > 0), True, False)
    add(7, whole & (t > 0), False, wide)
    add(8, one & (t > 0), True, False, p)
    add(9, one & (t > 0), False, wide, p)
    for x, own in ((p, both), (q, both & (p != q))):
        add(8, own & (n > 0), False, wide, x)
        add(9, own & (n > 0), True, False, x)
    return tuple(np.concatenate(x) for x in zip(*out))


def _link_rows(sequences: DataFrame, repeated: Sorted) -> DataFrame:
    sent = sequences.sparkSession.sparkContext.broadcast(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, h, ends in _unpacked(batch):
                v, row, left, p, q = variants(h, ends, own.column("level").to_numpy())
                there, n, t = _there(sent.value, v)
                v, row, left, p, q, n, t = (x[there] for x in (v, row, left, p, q, n, t))
                link, at, leads, follows = links(v, left, p, q, n, t, two(np.diff(ends)[row]))
                row = row[at]
                distinct = np.unique(np.stack([link.view(np.int64), row, leads, follows]), axis=1)
                taken = own.select(["h1", "h2", "level", "doc", "th", "line"]).take(pa.array(distinct[1]))
                yield pa.RecordBatch.from_pydict({"link": pa.array(distinct[0]), "leads": pa.array(distinct[2] > 0), "follows": pa.array(distinct[3] > 0)} | {x: taken.column(x) for x in taken.schema.names})

    return map_arrow(sequences, run, f"link long, leads boolean, follows boolean, h1 long, h2 long, level int, {REF}")


def _verify(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([np.frombuffer(x, dtype="<u8") for x in batch.column(n).to_pylist()] for n in ("units", "earlier_units"))
            yield batch.select(["h1", "h2"]).filter(pa.array([within(x, y, bound(len(x))) for x, y in zip(a, b)], pa.bool_()))

    return map_arrow(pairs, run, "h1 long, h2 long")


def near_lines(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within their bound."""
    parts = partitions(docs.sparkSession)
    shared = _shared_anchors(rows, parts)
    sequences = written(_sequences(docs, shared, _wanted(rows, shared, parts)), "line-sequences")
    linked = written(_link_rows(sequences, _repeated_variants(sequences, parts)), "line-links")
    first = linked.where("leads").groupBy("link").agg(F.min(F.struct("doc", "th", "line", "h1", "h2")).alias("f"))
    ref = F.struct("doc", "th", "line")
    met = linked.where("follows").join(first, "link").where(F.struct("f.doc", "f.th", "f.line") < ref)
    pairs = met.select("h1", "h2", "level", F.col("f.h1").alias("e1"), F.col("f.h2").alias("e2")).distinct()
    units = sequences.select("h1", "h2", "level", "units")
    earlier = units.toDF("e1", "e2", "level", "earlier_units")
    return _verify(pairs.join(units, ["h1", "h2", "level"]).join(earlier, ["e1", "e2", "level"])).distinct()


class Firsts(Mapped):
    """Lines that occur twice or more, by their hash, and where each is first."""

    names = ("keys", "h2", "first")


_OCCURRENCES = {"keys": "<u8", "h2": "<i8", "doc": "<i8", "th": "<i8", "line": "<i4", "first": "<u8", "n": "<i8"}


def _earliest(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The first occurrence of each line, and how many there are; by hash."""
    at = np.lexsort((x["line"], x["th"], x["doc"], x["h2"], x["keys"]))
    x = {k: v[at] for k, v in x.items()}
    new = np.concatenate(([True], (x["keys"][1:] != x["keys"][:-1]) | (x["h2"][1:] != x["h2"][:-1])))[: len(at)]
    first = np.flatnonzero(new)
    n = np.add.reduceat(x["n"], first) if len(first) else x["n"]
    return {k: v[first] for k, v in x.items()} | {"n": n}


def _firsts(rows: DataFrame, parts: int) -> Firsts:
    out = Firsts(shared_folder(rows.sparkSession, "repeated-lines"), parts)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                x = _earliest({k: np.concatenate([y[k] for y in held]) for k in _OCCURRENCES})
                held.clear()
                yield from by_range(x["keys"], parts, x)

        for batch in batches:
            x = {n: batch.column(n).to_numpy() for n in ("h2", "doc", "th", "line")}
            x |= {"keys": batch.column("h1").to_numpy().view(np.uint64) >> np.uint64(1), "first": _line_keys(batch.column("key").to_numpy(), x["line"]), "n": np.ones(len(batch), dtype=np.int64)}
            held.append(x)
            if sum(len(y["n"]) for y in held) > HELD:
                yield from flush()
        yield from flush()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        x = of_range(batches, task.partitionId(), parts, _OCCURRENCES)
        if x is not None:
            x = _earliest(x)
            out.save(task.partitionId(), task.taskAttemptId(), {k: v[x["n"] > 1] for k, v in x.items()})
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x["n"])], pa.int64())})

    packed = map_arrow(rows.select("h1", "h2", "doc", "th", "key", "line"), pack, "part int, " + ", ".join(f"{n} binary" for n in _OCCURRENCES))
    cut(map_arrow(packed.repartitionById(parts, F.col("part")), store, "n long"))
    return out


def dropped_lines(docs: DataFrame) -> Sorted:
    """Keys of all lines that go: how often as copies, and how often as near ones.

    Occurrences of a line don't meet: each looks up where the line is first.
    """
    parts = partitions(docs.sparkSession)
    rows = written(_line_rows(docs), "line-rows")
    firsts = _firsts(rows, parts)

    def pack_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts, most=HELD)
        for batch in batches:
            keys = _both(*(batch.column(n).to_numpy() for n in ("h1", "h2")))
            yield from adder.add(keys, np.ones(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
        yield from adder.flush()

    near, _ = store(map_arrow(near_lines(docs, rows), pack_near, PACKED), "near-lines", parts, lambda k, n, t: n > 0)
    sent = docs.sparkSession.sparkContext.broadcast((firsts, near))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts, most=HELD)
        firsts, near = sent.value
        for batch in batches:
            h1, h2, key, line = (batch.column(n).to_numpy() for n in ("h1", "h2", "key", "line"))
            own = _line_keys(key, line)
            at = np.argsort(h1.view(np.uint64), kind="stable")
            copy = np.zeros(len(at), dtype=bool)
            for part, there, row, hit in firsts.rows(h1.view(np.uint64)[at] >> np.uint64(1)):
                copy[part] = hit & (there["h2"][row] == h2[at][part]) & (there["first"][row] != own[at][part])
            exact = np.empty(len(at), dtype=bool)
            exact[at] = copy
            is_near = _there(near, _both(h1, h2))[0]
            gone = exact | is_near
            yield from adder.add(own[gone], (~is_near[gone]).astype(np.int64), is_near[gone].astype(np.int64))
        yield from adder.flush()

    return store(map_arrow(rows.select("h1", "h2", "key", "line"), pack, PACKED), "dropped-lines", parts, lambda k, n, t: n + t > 0)[0]


def _both(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return mix64(h1.view(np.uint64) ^ mix64(h2.view(np.uint64))) >> np.uint64(1)


def _line_keys(key: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix64(mix64(key.view(np.uint64)) + line.astype(np.uint64) * _ODD) >> np.uint64(1)


def _applied(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column (text: what stays, n_exact, n_near) beside them; the texts stay where they are."""
    gone = dropped_lines(docs)
    importable(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(gone)

    @F.arrow_udf("struct<text: string, n_exact: long, n_near: long>")
    def apply(text: pa.Array, key: pa.Array) -> pa.Array:
        release(__name__)
        out = [pa.array([], _STAYS)]
        for piece in slices(pa.RecordBatch.from_arrays([text, key], [TEXT, "key"]), most=PIECE):
            lists = pc.split_pattern(pc.fill_null(piece.column(TEXT), ""), "\n")
            ends = lists.offsets.to_numpy().astype(np.int64)
            number, doc = _runs(np.zeros(len(ends) - 1, dtype=np.int64), np.diff(ends))
            there, _, near = _there(sent.value, _line_keys(piece.column("key").to_numpy()[doc], number))
            n_near = np.bincount(doc[there & (near > 0)], minlength=len(piece))
            n_exact = np.bincount(doc[there], minlength=len(piece)) - n_near
            texts, lines, kept = piece.column(TEXT), lists.flatten(), pa.array(~there)
            changed = np.flatnonzero(n_near + n_exact)
            new = {k: "\n".join(lines[ends[k] : ends[k + 1]].filter(kept[ends[k] : ends[k + 1]]).to_pylist()) for k in changed.tolist()}
            mask = np.zeros(len(piece), dtype=bool)
            mask[changed] = True
            stay = pc.replace_with_mask(texts, pa.array(mask), pa.array(list(new.values()), pa.string())) if len(changed) else texts
            out.append(pa.StructArray.from_arrays([stay, pa.array(n_exact), pa.array(n_near)], fields=list(_STAYS)))
        trim()
        return pa.concat_arrays(out)

    (name,) = fresh(docs, "stays")
    d, h = F.coalesce(F.col(DOC).cast("long"), F.lit(NULL)), F.xxhash64(F.coalesce(F.col(TEXT), F.lit("")))
    return docs.withColumn(name, apply(F.col(TEXT), _key(d, h))), name


_STAYS = pa.struct([("text", pa.string()), ("n_exact", pa.int64()), ("n_near", pa.int64())])


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents with the dropped lines taken out of ``text``, and n_chars (if there) as it is then."""
    out, stays = _applied(docs)
    cols = []
    for c in docs.columns:
        if c == TEXT:
            cols.append(F.col(f"{stays}.text").alias(c))
        elif c == "n_chars":
            changed = F.col(f"{stays}.n_exact") + F.col(f"{stays}.n_near") > 0
            cols.append(F.when(changed, F.length(f"{stays}.text").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return out.select(*cols)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_exact and n_near dropped, and the SHA-256 of what stays."""
    out, stays = _applied(docs.select(DOC, TEXT))
    return out.select(
        F.col(DOC).cast("long").alias(DOC),
        (F.length(F.col(TEXT)) - F.length(F.replace(F.col(TEXT), F.lit("\n"))) + 1).cast("long").alias("n_lines"),
        F.col(f"{stays}.n_exact"),
        F.col(f"{stays}.n_near"),
        F.sha2(F.coalesce(F.col(f"{stays}.text"), F.lit("")), 256).alias("kept_sha256"),
    ).fillna(1, ["n_lines"])
