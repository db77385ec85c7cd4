"""Byte-level BPE by merge ranks, and decoding.

The symbols of a pre-token form a doubly linked list.  A priority queue holds
the ranks of adjacent pairs; the lowest rank, leftmost first, is merged, the
two new pairs enter the queue, and entries whose pair has changed meanwhile
are skipped when they come up.  Decoding concatenates the vocabulary's byte
strings.  A text is cut into chunks where the pattern is certain to cut; a
worker remembers the ids of chunks and pre-tokens up to a bound.

Null and empty texts have no ids and decode to the empty text.  Rows are
independent: repeated rows repeat their result, no rows give no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, TEXT, map_arrow, slices
from .vocab_files import vocab_path
from .word_encoder import MARKS, chunk_codes, spaced_chunks

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Chunks, and pre-tokens, that a worker remembers, from the second time on that it meets them; this changes speed only.
REMEMBERED = 150_000
_SLOTS = 1 << 22
_LOADED: dict[str, Bpe] = {}


def forget_memory() -> None:
    for model in _LOADED.values():
        model.chunks.clear()
        model.words.clear()


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        of = byte_letters()
        self.strings: dict[int, bytes] = {i: bytes(of[c] for c in token) for token, i in vocab.items()}
        self.byte_ids = [0] * 256
        for letter, b in of.items():
            self.byte_ids[b] = vocab[letter]
        #: first id -> second id -> rank; rank -> id of the merged symbol
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.merged: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[a]].setdefault(vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: t.encode() for t, i in self.special.items()}
        self.dtype = np.dtype("<u2") if max(self.strings) < 1 << 16 else np.dtype("<u4")
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.decimals = {i: b"%d," % i for i in self.strings}
        #: chunk -> its ids, these as decimals with a comma after each, and the strings they stand for
        self.chunks: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.words: dict[str, list[int]] = {}
        self.remembered = remembered
        self.met = bytearray(_SLOTS)
        self.specials = tuple(self.special)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        symbols = [self.byte_ids[b] for b in word]
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, merged = self.ranks, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        low = (1 << shift) - 1
        queue = [r << shift | k for k in range(n - 1) if (r := ranks[symbols[k]].get(symbols[k + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            entry = pop(queue)
            at, rank = entry & low, entry >> shift
            right = after[at]
            if (own := symbols[at]) < 0 or right >= n or ranks[own].get(symbols[right]) != rank:
                continue  # stale: a neighbour has been merged since
            symbols[at] = new = merged[rank]
            symbols[right] = -1
            after[at] = far = after[right]
            if far < n:
                before[far] = at
                if (r := ranks[new].get(symbols[far])) is not None:
                    push(queue, r << shift | at)
            if (left := before[at]) >= 0 and (r := ranks[symbols[left]].get(new)) is not None:
                push(queue, r << shift | left)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> list[int]:
        if (ids := self.words.get(word)) is None:
            ids = self.merge(word.encode())
            if len(self.words) < self.remembered and len(word) < 64 and self._again(hash(word)):
                self.words[word] = ids
        return ids

    def _again(self, hashed: int) -> bool:
        """Whether it has been met before, or something with the same slot has."""
        slot = hashed & _SLOTS - 1
        if self.met[slot]:
            return True
        self.met[slot] = 1
        return False

    def _plain(self, text: str) -> list[int]:
        tail = text[-1:] if text[-1:] in MARKS else ""
        word = text[: len(text) - len(tail)]
        letters = word[1:] if word[:1] == " " else word
        if letters.isascii() and letters.isalpha():  # one pre-token, and the mark another
            return self._word(word) + self._word(tail) if tail else self._word(word)
        return list(chain.from_iterable(map(self._word, self.pattern.findall(text))))

    def _chunk(self, chunk: str) -> list[int]:
        for token in self.specials:
            if token in chunk:
                break
        else:
            return self._plain(chunk)
        ids, at = [], 0
        for m in self.split.finditer(chunk):
            ids += self._plain(chunk[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._plain(chunk[at:])

    def pieces(self, chunks: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """For distinct chunks what ``self.chunks`` holds."""
        known = self.chunks
        found = list(map(known.get, chunks))
        strings, decimals = self.strings.__getitem__, self.decimals.__getitem__
        for k, own in enumerate(found):
            if own is None:
                ids = self._chunk(chunks[k])
                own = found[k] = array(self.dtype.char, ids).tobytes(), b"".join(map(decimals, ids)), b"".join(map(strings, ids))
                if len(known) < self.remembered and len(ids) < 32 and self._again(~hash(chunks[k]) >> 3):
                    known[chunks[k]] = own
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(x[0] for x in self.pieces(spaced_chunks(text))), dtype=self.dtype)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    if (found := _LOADED.get(path)) is None:
        found = _LOADED[path] = Bpe(path)
    return found


def encode_decode(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian), decoded text, and the digests of both."""
    vocab = vocab or vocab_path("byte_bpe_50k.json")
    schema = f"{DOC} long, n_tokens long, ids array<int>, decoded string, ids_sha256 string, decoded_sha256 string"
    return _run(docs, vocab, schema, whole=True)


def digests(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """As ``encode_decode``, but only the digests leave the workers."""
    vocab = vocab or vocab_path("byte_bpe_50k.json")
    return _run(docs, vocab, f"{DOC} long, n_tokens long, ids_sha256 string, decoded_sha256 string", whole=False)


def _run(docs: DataFrame, vocab: str, schema: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(vocab)
        size = model.dtype.itemsize
        for batch in batches:
            for piece in slices(batch, most=3_000_000):
                out: dict = {k: [] for k in ("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")}
                codes, offsets, keys = chunk_codes(piece.column(TEXT), lower_words=False)
                found = np.empty((3, len(keys)), dtype=object)
                for k, own in enumerate(zip(*model.pieces(keys))):
                    found[k] = own
                raw, decimals, strings = found
                n = np.fromiter(map(len, raw), dtype=np.int64, count=len(keys)) // size
                at = offsets.tolist()
                for a, b in zip(at, at[1:]):
                    own = codes[a:b]
                    decoded = b"".join(strings[own].tolist()).decode("utf-8", "replace")
                    out["n_tokens"].append(int(n[own].sum()))
                    out["ids_sha256"].append(hashlib.sha256(b"".join(decimals[own].tolist())[:-1]).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if whole:
                        out["ids"].append(np.frombuffer(b"".join(raw[own].tolist()), dtype=model.dtype).tolist())
                        out["decoded"].append(decoded)
                cols = {DOC: piece.column(DOC), "n_tokens": pa.array(out["n_tokens"], pa.int64())}
                if whole:
                    cols |= {"ids": pa.array(out["ids"], pa.list_(pa.int32())), "decoded": pa.array(out["decoded"], pa.string())}
                cols |= {k: pa.array(out[k], pa.string()) for k in ("ids_sha256", "decoded_sha256")}
                yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT)), run, schema)
