"""Token counts; huge documents are encoded in overlapping chunks that resynchronise.

A huge text is cut into chunks that overlap.  Each is encoded by the library
with offsets.  Two neighbours are spliced at the first pre-token boundary that
both have in their overlap, a little before the left one's end.  That is
proven stable: the pre-tokenizer reads from left to right without looking
back, so after a boundary the tokens depend on the text from there on alone;
and it looks ahead by at most two characters past a pre-token (or a special
token's length), so the left chunk's boundaries are those of the whole text up
to ``MARGIN`` characters before its end.  If no boundary is common, the left
chunk is widened, twice as far each time, to the end of the text at most.

Null and empty texts have 0 bytes and 0 tokens.  Rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, TEXT, map_arrow, slices
from .vocab_files import vocab_path
from .word_encoder import encoder, tokenizer

HUGE, CHUNK, OVERLAP, MARGIN, LIMIT = 32_768, 16_384, 256, 32, 512


class Chunk:
    """A chunk's ids, and for each pre-token its first character in the text and its first token."""

    def __init__(self, text: str, start: int, end: int, library):
        e = library.encode(text[start:end], add_special_tokens=False)
        self.end, self.ids = end, e.ids
        words = e.word_ids
        first = [k for k in range(len(words)) if not k or words[k] is None or words[k] != words[k - 1]]
        offsets = e.offsets
        self.at = {start + offsets[k][0]: k for k in reversed(first)}

    def stable(self, from_: int, whole: bool) -> Iterator[int]:
        last = self.end if whole else self.end - MARGIN
        return (p for p in sorted(self.at) if from_ <= p <= last)


def encode_huge(text: str, library, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """The ids of the whole text, spliced from overlapping chunks, which must overlap by more than ``MARGIN``."""
    if not chunk > 0 < MARGIN < overlap:
        raise ValueError(f"chunks must overlap by more than {MARGIN} characters")
    n = len(text)
    out: list[int] = []
    start = taken = 0  # where the left chunk begins; its first token that isn't yet out
    left = Chunk(text, 0, min(n, chunk + overlap), library)
    while left.end < n:
        begin = start + chunk
        right = Chunk(text, begin, min(n, begin + chunk + overlap), library)
        wide = overlap
        while True:
            common = next((p for p in left.stable(begin, left.end == n) if p in right.at and left.at[p] >= taken), None)
            if common is not None or left.end == n:
                break
            wide *= 2
            left = Chunk(text, start, min(n, begin + wide), library)
            if left.end > right.end:
                right = Chunk(text, begin, left.end, library)
        if common is None:
            break  # the left chunk reaches the end of the text
        out += left.ids[taken : left.at[common]]
        taken, start, left = right.at[common], begin, right
    return out + left.ids[taken:]


def token_counts(docs: DataFrame, vocab: str | None = None, limit: int = LIMIT, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and whether the text was spliced from chunks."""
    vocab = vocab or vocab_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, library = encoder(vocab, lower_words=False), tokenizer(vocab)
        for batch in batches:
            for piece in slices(batch):
                texts = pc.fill_null(piece.column(TEXT), "")
                spliced = pc.greater(pc.utf8_length(texts), huge)
                counts = enc.lengths(pc.if_else(spliced, "", texts))
                spliced = spliced.to_numpy(zero_copy_only=False)
                for k in np.flatnonzero(spliced).tolist():
                    counts[k] = len(encode_huge(texts[k].as_py(), library, chunk, overlap))
                yield pa.RecordBatch.from_pydict(
                    {
                        DOC: piece.column(DOC),
                        "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                        "n_tokens": pa.array(counts),
                        "over_limit": pa.array(counts > limit),
                        "spliced": pa.array(spliced),
                    }
                )

    return map_arrow(docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT)), run, f"{DOC} long, n_bytes long, n_tokens long, over_limit boolean, spliced boolean")
