"""What the operators share: shared folders, Arrow plumbing and hashing.

Conventions that hold for every operator of the subpackage:

* a document is a row with an integer ``doc_id`` and a ``text``; further
  columns are allowed, whatever their names, since each operator first selects
  what it needs;
* a null text counts as the empty text, unless the operator says otherwise;
* where rows must be told apart, a row's identity is ``(doc_id, hash of the
  text)``: rows that agree in both are decided together and get equal results.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import importable

DOC = "doc_id"
TEXT = "text"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Only where the setting is absent on a single machine (tests, a laptop) a
    temporary folder is made and set; on a cluster it would be another one on
    each machine, so there the setting is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        root = "file://" + tempfile.mkdtemp(prefix="specframe-checkpoint-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder under the checkpoint folder, as a path that every executor can open."""
    root = checkpoint_root(spark)
    parts = urlparse(root)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a shared POSIX folder, not {root}")
    folder = os.path.join(parts.path, f"{what}-{uuid.uuid4().hex}")
    os.makedirs(folder, exist_ok=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder; lost executors don't matter after it.

    The result knows nothing of the plan before it.  (A plain checkpoint keeps
    the plan's constraints, which multiply in loops.)
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    done = df.checkpoint(eager=True)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def written(df: DataFrame, what: str) -> DataFrame:
    """Materialise as Parquet in the shared folder, so that later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"file://{shared_folder(spark, what)}/table"
    df.write.parquet(path)
    return spark.read.parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow``; what other operators left in the worker's memory goes first."""
    importable(df.sparkSession)
    owner = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


_OWNER: list[str] = []


def release(owner: str) -> None:
    """Let the worker forget what modules but ``owner`` remember, where another one used it last."""
    if _OWNER == [owner]:
        return
    _OWNER[:] = [owner]
    for name, module in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name != owner and (forget := getattr(module, "forget_memory", None)):
            forget()
    trim()


_FROZEN: list[bool] = []


def trim() -> None:
    """Give free memory back to the machine, as far as the platform can."""
    gc.collect()
    if not _FROZEN:  # modules and the like stay; later collections needn't look at them
        gc.freeze()
        _FROZEN.append(True)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def strings_of(column: pa.Array) -> list[str]:
    """As ``to_pylist``, some times as fast."""
    return column.to_numpy(zero_copy_only=False).tolist()


def word_codes(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of all texts, and how many words each text has; cut as ``str.split`` does."""
    # Arrow may look at what lies behind the last text, so another one is put there.
    lists = pc.utf8_split_whitespace(pa.concat_arrays([pc.fill_null(column, ""), pa.array(["."], column.type)]))[:-1]
    flat = lists.flatten().dictionary_encode()
    codes, ends = flat.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
    words = strings_of(flat.dictionary)
    keep = np.array([bool(w) for w in words], dtype=bool)[codes] if words else np.zeros(0, dtype=bool)
    before = np.concatenate(([0], np.cumsum(keep)))
    return words, codes[keep], np.diff(before[ends])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like these that are no columns of the table."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batch: pa.RecordBatch, text: str = TEXT, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``most`` bytes of text, to bound memory."""
    column = batch.column(text)
    if batch.num_rows < 2 or column.nbytes <= most:
        yield batch
        return
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(first, last - first)
        first = last


def text_hash(column: Column | str) -> Column:
    """64 bits of identity of a text; null as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.xxhash64(F.coalesce(column, F.lit("")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
