"""Whole-text encoding with the ``tokenizers`` library, once for each distinct chunk.

A text is cut only where its pre-tokenizer is certain to cut, so the ids of
the text are the ids of its chunks, one after the other.  Arrow cuts a batch
of texts and numbers the distinct chunks, so Python looks at each of these
once a batch.  Chunks repeat, so each worker keeps the ids of those it has
met.  The memory has a bound: once it is full, new chunks are encoded for
their batch only.  Its size changes the speed, never the result.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import strings_of

#: Chunks that a worker remembers, at about 250 bytes each.
REMEMBERED = 300_000
#: Letters that are one pre-token, alone and unchanged by composition.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: Marks that are a pre-token of their own after letters.
MARKS = frozenset(".,;:!?|")
_LOADED: dict[tuple, object] = {}


def forget_memory() -> None:
    for (kind, *_), found in _LOADED.items():
        if kind == "encoder":
            found.known.clear()


def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation and padding, once per process."""
    if (found := _LOADED.get(("file", path))) is None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        _LOADED[("file", path)] = found
    return found


def chunk_codes(column: pa.Array, lower_words: bool) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The number of each chunk of all texts, where each text's chunks begin (and all end), and the distinct chunks.

    The lower-case word vocabulary drops blanks and newlines, so texts are cut
    at them.  For the byte-level one the chunks are those of ``spaced_chunks``:
    between most words a piece with the blank before it.
    """
    column = pc.fill_null(column, "")
    if lower_words:
        column = pc.replace_substring(column, "\n", " ")
    lists = pc.split_pattern(column, " ")
    pieces = lists.flatten().dictionary_encode()
    codes, offsets, keys = pieces.indices.to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64), strings_of(pieces.dictionary)
    if lower_words or not len(codes):
        return codes, offsets, keys
    beside = np.array([not x or x[0].isspace() or x[-1].isspace() for x in keys])
    whole = np.diff(offsets)
    special = np.flatnonzero((np.add.reduceat(beside[codes], offsets[:-1], dtype=np.int64) > 0) & (whole > 1))
    number: dict[str, int] = {}
    pieces_, keys = keys, [" " + x for x in keys]

    def of(chunk: str) -> int:
        if (k := number.get(chunk)) is None:
            k = number[chunk] = len(keys)
            keys.append(chunk)
        return k

    first = codes[offsets[:-1]]
    codes[offsets[:-1]] = [of(pieces_[k]) for k in first.tolist()]
    if len(special):
        parts = np.split(codes, offsets[1:-1])
        for k in special.tolist():
            parts[k] = np.array([of(x) for x in spaced_chunks(column[k].as_py())], dtype=np.int64)
        codes = np.concatenate(parts)
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
    return codes, offsets, keys


def gathered(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Runs of ``flat`` (one after the other, of these lengths) in the order of their numbers."""
    starts, n = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - n), n)]


def spaced_chunks(text: str) -> list[str]:
    """For the byte-level vocabulary: a single blank between two visible characters begins a pre-token.

    A chunk is cut before each such blank.  Where a blank has white space
    beside it, that blank stays inside its chunk, since the pattern looks
    ahead over runs of white space.
    """
    pieces = text.split(" ")
    if len(pieces) == 1:
        return pieces
    out = [pieces[0]]
    append = out.append
    for piece in pieces[1:]:
        append(" " + piece)
    for piece in pieces:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return _merge_runs(out)
    return out


def _merge_runs(chunks: list[str]) -> list[str]:
    """Join again the chunks between which the blank isn't alone."""
    out: list[str] = []
    held = chunks[0]
    for chunk in chunks[1:]:
        if not held or held[-1].isspace() or len(chunk) < 2 or chunk[1].isspace():
            held += chunk
        else:
            out.append(held)
            held = chunk
    out.append(held)
    return out


class Encoder:
    """ids of texts as little-endian 16-bit (or 32-bit) integers, chunk by chunk."""

    def __init__(self, path: str, lower_words: bool, remembered: int = REMEMBERED):
        self.library = tokenizer(path)
        self.lower_words = lower_words
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        self.marks = {"": b""} | {m: np.array(self.library.encode(m, add_special_tokens=False).ids, dtype=self.dtype).tobytes() for m in MARKS}
        if lower_words:
            self.ends = np.zeros(size, dtype=bool)
            for token, i in self.library.get_vocab(with_added_tokens=True).items():
                self.ends[i] = token.endswith("</w>")
        else:
            # A chunk begins with a blank, and in this vocabulary that is this letter.
            self.starts = np.zeros(size, dtype=bool)
            for token, i in self.library.get_vocab(with_added_tokens=True).items():
                self.starts[i] = token.startswith("Ġ")

    def _encode(self, chunks: list[str], into: dict[str, bytes]) -> None:
        words: set[str] = set()
        composed: list[tuple[str, str, str]] = []  # chunk = word (in lower case, where case is dropped) and a mark
        rest = []
        known, lower = self.known, self.lower_words
        for chunk in chunks:
            tail = chunk[-1:] if chunk[-1:] in MARKS else ""
            word = chunk[: len(chunk) - len(tail)]
            if not LETTERS.fullmatch(word if lower else word[1:]) or not lower and word[0] != " ":
                rest.append(chunk)
                continue
            if lower:
                word = word.lower()
            if word not in known:
                words.add(word)
            if tail or word != chunk:
                composed.append((chunk, word, tail))
        if words:
            self._encode_words(list(words), into)
        for chunk, word, tail in composed:
            into[chunk] = (into[word] if word in words else known[word]) + self.marks[tail]
        if rest:
            for chunk, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False)):
                into[chunk] = np.array(e.ids, dtype=self.dtype).tobytes()

    def _encode_words(self, words: list[str], into: dict[str, bytes]) -> None:
        """Many words in one call; where a word's ids begin shows in the vocabulary."""
        groups = [words[k : k + 500] for k in range(0, len(words), 500)]
        joined = [(" " if self.lower_words else "").join(g) for g in groups]
        for group, e in zip(groups, self.library.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            if self.lower_words:
                at = np.flatnonzero(self.ends[ids]) + 1
                at = np.concatenate(([0], at))
            else:
                at = np.concatenate((np.flatnonzero(self.starts[ids]), [len(ids)]))
            if len(at) != len(group) + 1:
                for word in group:
                    into[word] = np.array(self.library.encode(word, add_special_tokens=False).ids, dtype=self.dtype).tobytes()
                continue
            raw, size, at = ids.tobytes(), self.dtype.itemsize, at.tolist()
            for k, word in enumerate(group):
                into[word] = raw[at[k] * size : at[k + 1] * size]

    def ids_of(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks, as bytes of ``dtype``."""
        known = self.known
        found = list(map(known.get, chunks))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if missing:
            new = [chunks[k] for k in missing]
            # Words that chunks are put together from may come with them.
            own = known if len(known) + 2 * len(new) <= self.remembered else {}
            self._encode(new, own)
            for k, chunk in zip(missing, new):
                found[k] = own[chunk]
            if own is not known and (room := self.remembered - len(known)) > 0:
                known.update(islice(own.items(), room))
        return found

    def lengths(self, column: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        codes, offsets, keys = chunk_codes(column, self.lower_words)
        n = np.fromiter(map(len, self.ids_of(keys)), dtype=np.int64, count=len(keys)) // self.dtype.itemsize
        ends = np.concatenate(([0], np.cumsum(n[codes])))
        return ends[offsets[1:]] - ends[offsets[:-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of ``dtype``."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        codes, offsets, keys = chunk_codes(column, self.lower_words)
        ids = self.ids_of(keys)
        n = np.fromiter(map(len, ids), dtype=np.int64, count=len(keys)) // self.dtype.itemsize
        ends = np.concatenate(([0], np.cumsum(n[codes])))
        return gathered(np.frombuffer(b"".join(ids), dtype=self.dtype), n, codes), ends[offsets[1:]] - ends[offsets[:-1]]


def encoder(path: str, lower_words: bool) -> Encoder:
    """One encoder per process and file: workers that are used again keep what they learnt."""
    if (found := _LOADED.get(("encoder", path, lower_words))) is None:
        found = _LOADED[("encoder", path, lower_words)] = Encoder(path, lower_words)
    return found
