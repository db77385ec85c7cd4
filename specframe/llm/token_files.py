"""Token ids in flat binary files with 64-bit document offsets.

Documents are range-partitioned by id.  Each task encodes its documents and
appends their ids to one flat file of unsigned integers (16 bits if the
vocabulary allows, else 32), beside a file of document ids and 64-bit local
offsets.  A row per file then says how many ids it holds; the prefix sum of
those counts is each file's base.  Readers memory-map the files.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOC, TEXT, cut, map_arrow, partitions, shared_folder, slices, text_hash
from .vocab_files import vocab_path
from .word_encoder import encoder

END = 2
MANIFEST = "part int, n_docs long, n_tokens long, width int"
#: A record of the offsets file: id, whether it is null, first id of the document in this file, number of ids.
OFFSETS = np.dtype([("doc_id", "<i8"), ("null", "<i8"), ("start", "<i8"), ("n", "<i8")])


def _names(folder: str, part: int) -> tuple[str, str]:
    return os.path.join(folder, f"tokens-{part:06d}.bin"), os.path.join(folder, f"offsets-{part:06d}.bin")


def write_token_files(docs: DataFrame, folder: str | None = None, vocab: str | None = None, end: int = END, files: int | None = None) -> DataFrame:
    """Write the files and return the manifest: part, n_docs, n_tokens, width, base.

    Each file is written under a name of its own attempt and then renamed, so a
    task that runs twice leaves one whole file.  Null texts count as empty: the
    document is its end id alone.  Null ids come first.  Rows that repeat an id
    lie together, ordered by the hash of their texts.  No rows: no files.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "token-files")
    vocab = vocab or vocab_path("word_bpe_49k.json")
    n = files or partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part = task.partitionId()
        names = _names(folder, part)
        own = [f"{x}.{task.taskAttemptId()}" for x in names]
        enc = encoder(vocab, lower_words=True)
        width, total, count = enc.dtype.itemsize, 0, 0
        with open(own[0], "wb") as tokens, open(own[1], "wb") as offsets:
            for batch in batches:
                for piece in slices(batch):
                    ids, sizes = enc.encode_column(piece.column(TEXT))
                    out = np.full(len(ids) + len(sizes), end, dtype=enc.dtype)
                    out[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                    rec = np.zeros(len(sizes), dtype=OFFSETS)
                    docs_ = piece.column(DOC)
                    rec["doc_id"] = pc.fill_null(docs_.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
                    rec["null"] = docs_.is_null().to_numpy(zero_copy_only=False)
                    rec["n"] = sizes + 1
                    rec["start"] = total + np.cumsum(rec["n"]) - rec["n"]
                    total += len(out)
                    count += len(sizes)
                    tokens.write(out.tobytes())
                    offsets.write(rec.tobytes())
        for a, b in zip(own, names):
            os.replace(a, b)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": [count], "n_tokens": [total], "width": pa.array([width], pa.int32())})

    ordered = docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT)).repartitionByRange(n, DOC, text_hash(TEXT)).sortWithinPartitions(DOC, text_hash(TEXT))
    manifest = cut(map_arrow(ordered, write, MANIFEST))
    # One row for each file: the only window without partitions here, and a small one.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start, n_tokens, ids_crc32, part; ids stay in the mapped files."""
    schema = f"{DOC} long, start long, n_tokens long, ids_crc32 long, part int"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["n_docs"]:
                    continue
                names = _names(row["folder"], row["part"])
                ids = np.memmap(names[0], dtype=f"<u{row['width']}", mode="r")
                where = np.memmap(names[1], dtype=OFFSETS, mode="r")
                for k in range(0, len(where), 10_000):
                    own = where[k : k + 10_000]
                    sums = [zlib.crc32(ids[s : s + n].astype("<u4").tobytes()) for s, n in zip(own["start"].tolist(), own["n"].tolist())]
                    yield pa.RecordBatch.from_pydict(
                        {
                            DOC: pa.array(own["doc_id"].copy(), mask=own["null"] != 0),
                            "start": row["base"] + own["start"],
                            "n_tokens": own["n"].copy(),
                            "ids_crc32": pa.array(sums, pa.int64()),
                            "part": pa.array([row["part"]] * len(own), pa.int32()),
                        }
                    )

    n = partitions(manifest.sparkSession)
    return map_arrow(manifest.repartitionById(n, F.col("part") % n), read, schema)


def token_ids(manifest_row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a file, from the mapped file."""
    names = _names(manifest_row["folder"], manifest_row["part"])
    rec = np.memmap(names[1], dtype=OFFSETS, mode="r")[k]
    return np.memmap(names[0], dtype=f"<u{manifest_row['width']}", mode="r")[rec["start"] : rec["start"] + rec["n"]]
