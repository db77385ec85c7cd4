"""Cross-entropy difference under matched target and background bigram models.

Both models have the same form and share one vocabulary.  The background is
counted over all documents, the target over those labelled good.  The
vocabulary holds every word that occurs ``LEAST`` times or more in the corpus,
so it grows with the corpus; words that occur once are one symbol, and one
more stands before and after each text.  A bigram's probability is
(count + m * unigram) / (count of its first word + m), where m is that last
count to the power ``HEAPS``, about as many different words as follow a word;
unigrams have one added to their count.

A document's score is its mean loss in bits per word (and end) under the target
less that under the background: the lower, the more it is like the target.  A
target document is scored without its own counts in the target (they are
subtracted), so it has no advantage over equally good ones without a label.
``selected`` are those that score no more than a share ``SHARE`` of the target
documents does.

Words and bigrams both go by 63-bit hashes.  Workers add up what they count,
cut it by ranges of the hash and send one packed row for each range; what comes
together is added up and stored in sorted files, one for each range, that
workers map and search.  Nothing of it is broadcast or collected.

Null and empty texts have no words and null losses.  Without target documents
the target has no counts and nothing is selected.  Labels that repeat an id
count as the best of them; a document without an id is never a target.  Rows
that repeat count as often as they occur.  Two bigrams in some 10**18 pairs
share a hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, TEXT, cut, map_arrow, mix64, partitions, slices, word_codes
from .ranges import PACKED, Adder, Sorted, store

LEAST, HEAPS, SHARE = 2, 0.7, 0.9
#: What stands for words that occur once, and for the place before and after a text.
OTHER, BOUNDARY = 0, 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each word of all texts, the number of the word among the distinct ones, and how many words each text has.

    The words are those of ``words_of``; each distinct one is hashed once.
    """
    words, codes, sizes = word_codes(column)
    return hashes(w.lower() for w in words), codes, sizes


def hashes(words: Iterable[str]) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in words], dtype=np.uint64) >> np.uint64(1)
    return np.maximum(h, np.uint64(BOUNDARY + 1))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT))


def _signed(keys: np.ndarray) -> np.ndarray:
    """Hash of an id, as a key."""
    return mix64(keys.astype(np.int64).view(np.uint64)) >> np.uint64(1)


def target_ids(labels: DataFrame, parts: int) -> Sorted:
    """The ids labelled good, stored by hash; labels grow with the documents, so they aren't sent to meet the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts)
        for batch in batches:
            keys = _signed(batch.column(0).to_numpy())
            yield from adder.add(keys, np.ones(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64))
        yield from adder.flush()

    good = labels.select(F.col(DOC).cast("long").alias("l"), "quality").where("l is not null and quality = 1").select("l")
    return store(map_arrow(good, run, PACKED), "labels", parts, lambda k, n, t: n > 0)[0]


def is_target(ids: pa.Array, good: Sorted) -> np.ndarray:
    h = _signed(ids.fill_null(0).to_numpy(zero_copy_only=False))
    at = np.argsort(h)
    out = np.zeros(len(h), dtype=bool)
    out[at] = good.find(h[at])[0]
    return out & ids.is_valid().to_numpy(zero_copy_only=False)


def word_counts(docs: DataFrame, good: Sorted) -> DataFrame:
    """Packed counts of each word, in all and in target documents; of texts as the boundary."""
    sent, parts = docs.sparkSession.sparkContext.broadcast(good), good.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts)
        for batch in batches:
            for piece in slices(batch):
                h, codes, sizes = coded(piece.column(TEXT))
                target = is_target(piece.column(DOC), sent.value)
                n = np.bincount(codes, minlength=len(h))
                t = np.bincount(codes[np.repeat(target, sizes)], minlength=len(h))
                own = n > 0
                texts = np.array([(sizes > 0).sum()]), np.array([(target & (sizes > 0)).sum()])
                yield from adder.add(np.append(h[own], np.uint64(BOUNDARY)), np.append(n[own], texts[0]), np.append(t[own], texts[1]))
        yield from adder.flush()

    return map_arrow(_documents(docs), run, PACKED)


class Text:
    """A batch of texts as symbols: the word's hash, or OTHER, between boundaries."""

    def __init__(self, column: pa.Array, words: Sorted):
        h, codes, self.sizes = coded(column)
        at = np.argsort(h)
        there, n, t = words.find(h[at])
        of = np.empty((3, len(h)), dtype=np.int64)
        of[:, at] = np.where(there, h[at], OTHER).view(np.int64), np.where(there, n, -1), np.where(there, t, -1)
        some = self.sizes > 0
        # One boundary ends a text and begins the next.
        ends = np.cumsum(self.sizes[some] + 1)
        total = int(ends[-1]) if len(ends) else 0
        word = np.ones(total + 1, dtype=bool)
        word[0] = False
        word[ends] = False
        self.symbols = np.full(total + 1, BOUNDARY, dtype=np.int64)
        self.counts = np.full((2, total + 1), -2, dtype=np.int64)
        self.symbols[word] = of[0][codes]
        self.counts[:, word] = of[1:, codes]
        self.doc = np.repeat(np.arange(len(self.sizes)), np.where(some, self.sizes + 1, 0))
        with np.errstate(over="ignore"):
            s = self.symbols.view(np.uint64)
            self.grams = mix64(mix64(s[:-1] + _ODD) * _ODD + s[1:]) >> np.uint64(1)


def bigram_counts(docs: DataFrame, words: Sorted, good: Sorted) -> DataFrame:
    sent, parts = docs.sparkSession.sparkContext.broadcast((words, good)), words.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adder = Adder(parts)
        words, good = sent.value
        for batch in batches:
            for piece in slices(batch):
                text = Text(piece.column(TEXT), words)
                target = is_target(piece.column(DOC), good)[text.doc].astype(np.int64)
                yield from adder.add(text.grams, np.ones(len(target), dtype=np.int64), target)
        yield from adder.flush()

    return map_arrow(_documents(docs), run, PACKED)


class Model:
    """The mapped counts and what they add up to."""

    def __init__(self, words: Sorted, bigrams: Sorted, size: int, totals: tuple[int, int], others: tuple[int, int], texts: tuple[int, int]):
        self.words, self.bigrams, self.size, self.totals, self.others, self.texts = words, bigrams, size, totals, others, texts

    def losses(self, column: pa.Array, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, and the mean bits under target and background."""
        text = Text(column, self.words)
        distinct, back = np.unique(text.grams, return_inverse=True)
        found = self.bigrams.find(distinct)[1:]
        out = []
        docs = np.maximum(np.bincount(text.doc, minlength=len(text.sizes)), 1)
        for k in (1, 0):
            whole = text.counts[k].copy()
            whole[whole == -1] = self.others[k]
            whole[whole == -2] = self.texts[k]
            gram, first, second, total = found[k][back], whole[:-1], whole[1:], np.full(len(back), self.totals[k])
            if k and target.any():
                own = target[text.doc]
                gram, first, second = gram.copy(), first.copy(), second.copy()
                doc = text.doc[own]
                for values, of in ((gram, text.grams.view(np.int64)), (first, text.symbols[:-1]), (second, text.symbols[1:])):
                    values[own] -= _within(doc, of[own])
                total[own] -= docs[doc]
            m = np.maximum(first, 1) ** HEAPS
            p = (gram + m * (second + 1) / (total + self.size)) / (first + m)
            out.append(np.bincount(text.doc, weights=-np.log2(p), minlength=len(text.sizes)) / docs)
        return text.sizes, *out


def _within(doc: np.ndarray, values: np.ndarray) -> np.ndarray:
    """How often each value occurs in its document."""
    at = np.lexsort((values, doc))
    d, v = doc[at], values[at]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (v[1:] != v[:-1]))))
    n = np.diff(np.append(first, len(at)))
    out = np.empty(len(at), dtype=np.int64)
    out[at] = np.repeat(n, n)
    return out


def fit(docs: DataFrame, labels: DataFrame, least: int = LEAST) -> tuple[Model, Sorted]:
    parts = partitions(docs.sparkSession)
    good = target_ids(labels, parts)
    words, (size, n, t, all_n, all_t) = store(word_counts(docs, good), "words", parts, lambda k, n, t: (n >= least) | (k == np.uint64(BOUNDARY)))
    bigrams, _ = store(bigram_counts(docs, words, good), "bigrams", parts, lambda k, n, t: n > 0)
    texts = [int(x[0]) for x in words.find(np.array([BOUNDARY], dtype=np.uint64))[1:]]
    return Model(words, bigrams, size + 1, (all_n, all_t), (all_n - n, all_t - t), tuple(texts)), good


def score(docs: DataFrame, labels: DataFrame, least: int = LEAST, share: float = SHARE, threshold: float | None = None) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score, selected (null without words).

    Selected is what scores at most ``threshold``; without one, at most what a
    share of the target documents does.
    """
    model, good = fit(docs, labels, least)
    sent = docs.sparkSession.sparkContext.broadcast((model, good))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, good = sent.value
        for batch in batches:
            for piece in slices(batch):
                target = is_target(piece.column(DOC), good)
                sizes, a, b = model.losses(piece.column(TEXT), target)
                none = sizes == 0
                yield pa.RecordBatch.from_pydict({DOC: piece.column(DOC), "n_tokens": pa.array(sizes)} | {k: pa.array(x, mask=none) for k, x in (("target_loss", a), ("background_loss", b), ("score", a - b))} | {"is_target": pa.array(target)})

    scored = map_arrow(_documents(docs), run, f"{DOC} long, n_tokens long, target_loss double, background_loss double, score double, is_target boolean")
    if threshold is None:
        scored = cut(scored)
        threshold = scored.where("is_target").agg(F.percentile_approx("score", share, 10_000)).first()[0]
    chosen = F.lit(False) if threshold is None else F.col("score") <= threshold
    return scored.withColumn("selected", F.when(F.col("score").isNotNull(), chosen)).drop("is_target")
