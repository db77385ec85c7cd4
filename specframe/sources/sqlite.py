"""Elements in SQLite files, as tables (ID, xml): a data source that reads ranges of ids, and a writer.

It also shows how a source of one's own is made: whatever gives (id, element)
rows can be passed to ``mzml.spectra_from_xml``.
"""

from __future__ import annotations

import os
import shutil
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from specframe.session import importable


def write(elements: DataFrame, path: str, table: str = "Spectra") -> int:
    """Write (id, element) to one file in a shared folder; how many there are.

    SQLite has one writer, so each task fills a file of its own beside it, and
    SQLite copies these into the one file: no element comes to the driver as a row.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    folder = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder)
    create = f'CREATE TABLE "{table}" (ID INTEGER PRIMARY KEY, xml TEXT)'

    def opened(file: str) -> sqlite3.Connection:
        """A new file, which gets its name when it is whole, so a journal would be of no use."""
        con = sqlite3.connect(file, isolation_level=None)
        con.execute("PRAGMA journal_mode = OFF")
        con.execute("PRAGMA synchronous = OFF")
        return con

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        own = os.path.join(folder, f"{task.partitionId()}-{task.taskAttemptId()}.db")
        con, n = opened(own), 0
        con.execute(create)
        con.execute("BEGIN")
        for batch in batches:
            con.executemany(f'INSERT INTO "{table}" VALUES (?, ?)', ((i.as_py(), e.as_py()) for i, e in zip(*batch.columns)))
            n += batch.num_rows
        con.execute("COMMIT")
        con.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "own": [own], "n": pa.array([n], pa.int64())})

    importable(elements.sparkSession)
    parts = sorted(elements.select("id", "element").mapInArrow(fill, "part long, own string, n long").collect())
    own = f"{path}.{os.getpid()}"
    if os.path.exists(own):
        os.remove(own)
    con = opened(own)
    con.execute(create)
    for r in parts:
        con.execute("ATTACH ? AS part", (r.own,))
        con.execute(f'INSERT INTO main."{table}" SELECT ID, xml FROM part."{table}" ORDER BY ID')
        con.execute("DETACH part")
        os.remove(r.own)
    con.close()
    shutil.rmtree(folder)
    os.replace(own, path)
    return sum(r.n for r in parts)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "Spectra")
        self.rows = int(options.get("rowsperpartition", 1000))

    def _query(self, sql: str, *values: int) -> list[tuple]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        try:
            return con.execute(sql.format(self.table), values).fetchall()
        finally:
            con.close()

    def partitions(self) -> list[_Range]:
        ((low, high),) = self._query('SELECT min(ID), max(ID) FROM "{}"')
        return [_Range(0, -1)] if low is None else [_Range(k, min(k + self.rows - 1, high)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self._query('SELECT ID, xml FROM "{}" WHERE ID BETWEEN ? AND ? ORDER BY ID', partition.low, partition.high)


class SqliteSource(DataSource):
    """``spark.read.format("sqlite-elements").load(path)``: (id, element)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite-elements"

    def schema(self) -> str:
        return "id long, element string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, table: str = "Spectra") -> DataFrame:
    importable(spark)
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite-elements").option("table", table).load(path)
