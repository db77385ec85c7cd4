"""Gzip files with an index: any gzip reader reads them, and blocks can be sought by id.

The first member's comment holds the index: ``FU``, a version byte, the widths
of an id and of an offset (a byte each), then a slot (id, offset) for each
block, both right-aligned in their width, and a zero byte.  Unused slots are
filled with 1, padding is 0xAC.  Offsets point behind the block's header.
"""

from __future__ import annotations

import os
import shutil
import struct
import time
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from specframe.session import importable

MAGIC, VERSION, PAD, UNUSED, WIDTH = b"FU", 1, b"\xac", b"\x01", 8
FCOMMENT = 16


class IgzipWriter:
    """Blocks of text by id; ``close`` writes the index."""

    def __init__(self, path: str, most: int = 10_000, id_width: int = WIDTH, offset_width: int = WIDTH, level: int = 6):
        self.out = open(path, "w+b")
        self.most, self.id_width, self.offset_width, self.level = most, id_width, offset_width, level
        self.index: dict[str, int] = {}
        self.locked = False
        self._header(FCOMMENT)
        self.out.write(MAGIC + bytes([VERSION, id_width, offset_width]))
        self.slots = self.out.tell()
        self.out.write(UNUSED * (most * (id_width + offset_width)) + b"\x00")
        self.fresh = True

    def _header(self, flags: int) -> None:
        self.out.write(b"\x1f\x8b\x08" + bytes([flags]) + struct.pack("<I", int(time.time()) & 0xFFFFFFFF) + b"\x00\xff")

    def add(self, block: str | bytes, id_: str | int) -> bool:
        """Whether there was a slot left."""
        if self.locked:
            raise ValueError("the index has been written")
        name = str(id_).encode("latin-1")
        if len(name) > self.id_width:
            raise ValueError(f"an id of {len(name)} bytes in slots of {self.id_width}")
        if len(self.index) >= self.most:
            return False
        data = block.encode("latin-1") if isinstance(block, str) else block
        if not self.fresh:
            self._header(0)
        self.fresh = False
        self.index[str(id_)] = self.out.tell()
        pack = zlib.compressobj(self.level, zlib.DEFLATED, -zlib.MAX_WBITS)
        self.out.write(pack.compress(data) + pack.flush())
        self.out.write(struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))
        return True

    def write_index(self) -> None:
        self.locked = True
        if self.fresh:  # a member needs data, be it none
            self.locked = False
            self.add(b"", "")
            self.index.clear()
            self.locked = True
        self.out.seek(self.slots)
        for id_, offset in self.index.items():
            name, at = id_.encode("latin-1"), str(offset).encode()
            if len(at) > self.offset_width:
                raise ValueError("the file is too long for its offsets")
            self.out.write(name.rjust(self.id_width, PAD) + at.rjust(self.offset_width, PAD))
        self.out.seek(0, os.SEEK_END)

    def close(self) -> None:
        if not self.locked:
            self.write_index()
        self.out.close()

    def __enter__(self) -> IgzipWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def is_indexed(path: str) -> bool:
    with open(path, "rb") as f:
        head = f.read(13)
    return head[:2] == b"\x1f\x8b" and len(head) == 13 and bool(head[3] & FCOMMENT) and head[10:12] == MAGIC


def read_index(path: str) -> dict[str, int]:
    if not is_indexed(path):
        raise ValueError(f"{path} has no index")
    out = {}
    with open(path, "rb") as f:
        f.seek(12)
        _, a, b = f.read(3)
        while len(slot := f.read(a + b)) == a + b:
            id_, offset = slot[:a].lstrip(PAD), slot[a:].lstrip(PAD)
            if not offset.isdigit():
                break
            out[id_.decode("latin-1")] = int(offset)
    return out


def read_block(path: str, offset: int) -> bytes:
    """The block whose data begin there; a block knows its own end."""
    unpack = zlib.decompressobj(-zlib.MAX_WBITS)
    out = []
    with open(path, "rb") as f:
        f.seek(offset)
        while not unpack.eof and (chunk := f.read(64_000)):
            out.append(unpack.decompress(chunk))
    return b"".join(out)


def mzml_blocks(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(id, text): the head, each spectrum and chromatogram, what lies between, the tail."""
    import re

    held: list[str] = []
    kind, name, n = None, None, 0
    for line in lines:
        if kind is None and (m := re.search(r'<(spectrum|chromatogram)\s[^>]*\bid="([^"]*)"', line)):
            if held:
                yield ("Head" if not n else f"junk{n}"), "".join(held)
                held = []
            kind = m[1]
            digits = re.search(r"(\d+)$", m[2])
            name = digits[1] if kind == "spectrum" and digits else m[2]
            n += 1
        held.append(line)
        if kind and f"</{kind}>" in line:
            yield name, "".join(held)
            held, kind = [], None
    if held:
        yield "tail", "".join(held)


def index_mzml(source: str, target: str, encoding: str = "latin-1") -> int:
    """Convert a plain mzML file; how many blocks it has."""
    with open(source, encoding=encoding, newline="") as f:
        blocks = list(mzml_blocks(f))
    width = max([WIDTH, *(len(i.encode("latin-1")) for i, _ in blocks)])
    with IgzipWriter(target, len(blocks), width, 12) as out:
        for i, text in blocks:
            out.add(text, i)
    return len(blocks)


def write(blocks: DataFrame, path: str, most: int | None = None) -> int:
    """Write (id, block) to one file in a shared folder, partition after partition; how many there are.

    The index has as many slots as there are blocks, or ``most``.  Each task packs its blocks into a part beside the file.  Sizes and widths of
    the parts give each one's place, so tasks put their blocks and slots there.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    spark = blocks.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder)
    header = b"\x1f\x8b\x08%c" + struct.pack("<I", int(time.time()) & 0xFFFFFFFF) + b"\x00\xff"
    plain = header % 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = os.path.join(folder, f"{task.partitionId()}-{task.taskAttemptId()}")
        n, at, width = 0, 0, 0
        with open(own, "wb") as out, open(f"{own}.index", "wb") as index:
            for batch in batches:
                for id_, block in zip(*batch.columns):
                    name, data = str(id_.as_py()).encode("latin-1"), block.as_py()
                    data = data.encode("latin-1") if isinstance(data, str) else data
                    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
                    member = plain + packer.compress(data) + packer.flush() + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
                    out.write(member)
                    index.write(struct.pack("<HQ", len(name), at + len(plain)) + name)
                    n, at, width = n + 1, at + len(member), max(width, len(name))
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "own": [own], "n": pa.array([n], pa.int64()), "size": pa.array([at], pa.int64()), "width": pa.array([width], pa.int64())})

    importable(spark)
    parts = sorted(r for r in blocks.select("id", "block").mapInArrow(pack, "part long, own string, n long, size long, width long").collect() if r.n)
    n = sum(r.n for r in parts)
    free = 0 if most is None else most - n
    if free < 0:
        raise ValueError(f"more than {most} blocks")
    id_width = max([WIDTH, *(r.width for r in parts)])
    if id_width > 255:
        raise ValueError(f"an id of {id_width} bytes in slots of 255")
    # The first member has the index in its header, so its own header is left out.
    slots = len(plain) + len(MAGIC) + 3
    total = sum(r.size for r in parts)
    offset_width = WIDTH
    while len(str(slots + (n + free) * (id_width + offset_width) + 1 + total)) > offset_width:
        offset_width += 1
    slot = id_width + offset_width
    first = slots + (n + free) * slot + 1
    if not n:
        with IgzipWriter(path, max(1, free)):
            return 0
    own = f"{path}.{os.getpid()}"
    with open(own, "wb") as out:
        out.write(header % FCOMMENT + MAGIC + bytes([VERSION, id_width, offset_width]))
        out.seek(slots + n * slot)
        out.write(UNUSED * (free * slot))
        out.truncate(first + total - len(plain))
    places, k, at = [], 0, first - len(plain)
    for r in parts:
        places.append((r.own, slots + k * slot, at))
        k, at = k + r.n, at + r.size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for which in batch.column(0).to_pylist():
                part, index_at, data_at = places[which]
                with open(own, "r+b") as out, open(part, "rb") as data, open(f"{part}.index", "rb") as index:
                    out.seek(index_at)
                    while head := index.read(10):
                        length, offset = struct.unpack("<HQ", head)
                        out.write(index.read(length).rjust(id_width, PAD) + str(data_at + offset).encode().rjust(offset_width, PAD))
                    skip = 0 if which else len(plain)
                    data.seek(skip)
                    out.seek(data_at + skip)
                    shutil.copyfileobj(data, out, 1 << 20)
                yield pa.RecordBatch.from_pydict({"n": pa.array([1], pa.int64())})

    spark.range(0, len(places), 1, len(places)).mapInArrow(place, "n long").count()
    shutil.rmtree(folder)
    os.replace(own, path)
    return n


def convert_folder(spark: SparkSession, sources: list[str], target_folder: str) -> DataFrame:
    """One task for each file; files that are there already are left alone."""
    pairs = [(s, os.path.join(target_folder, os.path.basename(s) + ".gz")) for s in sources]
    rows = spark.createDataFrame(pairs, "source string, target string").repartition(max(1, len(pairs)))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = []
            for r in batch.to_pylist():
                if os.path.exists(r["target"]):
                    n.append(0)
                    continue
                own = f"{r['target']}.{os.getpid()}"
                n.append(index_mzml(r["source"], own))
                os.replace(own, r["target"])
            yield pa.RecordBatch.from_pydict({"source": batch.column(0), "target": batch.column(1), "blocks": pa.array(n, pa.int64())})

    return rows.mapInArrow(run, "source string, target string, blocks long")


class _Blocks(InputPartition):
    def __init__(self, path: str, blocks: list[tuple[str, int]]):
        self.path, self.blocks = path, blocks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.only = options.get("ids")
        self.size = int(options.get("blocksperpartition", 1000))

    def partitions(self) -> list[_Blocks]:
        wanted = None if self.only is None else set(self.only.split(","))
        out = []
        for path in self.paths:
            blocks = [b for b in read_index(path).items() if wanted is None or b[0] in wanted]
            out += [_Blocks(path, blocks[k : k + self.size]) for k in range(0, len(blocks), self.size)]
        return out or [_Blocks("", [])]

    def read(self, partition: _Blocks) -> Iterator[tuple]:
        for id_, offset in partition.blocks:
            yield partition.path, id_, offset, read_block(partition.path, offset).decode("latin-1")


class IgzipSource(DataSource):
    """``spark.read.format("igzip").option("ids", "3,7").load(path)``: blocks, sought by the index."""

    @classmethod
    def name(cls) -> str:
        return "igzip"

    def schema(self) -> str:
        return "path string, id string, offset long, text string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_igzip(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Blocks (path, id, offset, text) of files (separated by commas): all, or those of some ids."""
    importable(spark)
    spark.dataSource.register(IgzipSource)
    reader = spark.read.format("igzip")
    return (reader if ids is None else reader.option("ids", ",".join(ids))).load(path)
