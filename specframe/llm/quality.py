"""Quality classifier: document evidence, shrunk site posteriors, empirical Bayes.

Document evidence is a naive Bayes log-odds over hashed features: a text's
distinct words, and the octaves of a few shares (signs, capitals, bars,
repeated lines and words, word length).  It is fitted on at most ``SAMPLE``
labelled documents, those of the least hash of their ids.  Copies among them
would make their words look telling, so a document weighs one over the number
of sampled documents that share one of ``KEYS`` minimum hashes of its
five-word runs with it.  Only features of a signed root of the likelihood ratio of
``SIGNIFICANT`` or more count.  There are two heads, quality and toxicity.

Sites have two levels, host and path.  For documents with a ``url`` these are
its host and the first segment of its path, else the columns ``source`` and
``lang``.  A host's posterior mean is the sum of its documents' probabilities
shrunk towards the global mean by as many pseudo-documents as the spread among
hosts says (method of moments); a path's is shrunk towards its host's in the
same way.  So sparse sites fall back on what is above them.  A document's
posterior log-odds are its own plus its path's less the global ones; nothing but
the shrinkage bounds the site's part.  Sums are grouped; a hot site is split by
salt when its figures go back to its documents.

Null texts count as empty: they have the prior and the site's evidence only.
Null hosts and paths are sites of their own.  Labels that repeat an id count by
their greatest values.  Without labels, or without both classes, a head has no
features and its prior is one half.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, TEXT, cut, map_arrow, mix64, slices, texts_of

SAMPLE, SIGNIFICANT, KEYS, SALT, MOST = 20_000, 5.0, 4, 32, 1e4
#: Stands for every document among the features.
EVERY = -1
HEADS = ("quality", "toxic")
WORD = re.compile(r"\w+")
_WORDS: dict[str, int] = {}


def forget_memory() -> None:
    _WORDS.clear()


def _number(feature: str) -> int:
    if (n := _WORDS.get(feature)) is None:
        n = xxhash.xxh3_64_intdigest(feature) >> 1
        if len(_WORDS) < 300_000:
            _WORDS[feature] = n
    return n


def features(text: str) -> np.ndarray:
    """Distinct numbers of a text's features."""
    words = WORD.findall(text.lower())
    n, lines = max(1, len(text)), text.split("\n")
    shares = {
        "signs": sum(text.count(c) for c in "#*$%&") / n,
        "shouts": text.count("!") / n,
        "bars": text.count("|") / n,
        "capitals": sum(map(str.isupper, text)) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "words": 1 - len(set(words)) / max(1, len(words)),
    }
    own = {f"\x00{k}:{'none' if v <= 0 else round(np.log2(v))}" for k, v in shares.items()}
    own.add(f"\x00length:{round(2 * np.log2(1 + len(text) / max(1, len(words))))}")
    own.add(f"\x00size:{round(np.log2(1 + len(words)))}")
    return np.unique(np.array([_number(x) for x in own | set(words)], dtype=np.int64))


def sample_of(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """At most ``sample`` labelled ids, by hash, and their labels."""
    one = labels.groupBy(F.col(DOC).cast("long").alias("l")).agg(*[F.max(h).cast("int").alias(h) for h in HEADS]).where("l is not null")
    return one.orderBy(F.xxhash64("l"), "l").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Priors' log-odds, the telling features, ascending, and their weights, for each head."""
    chosen = cut(sample_of(labels, sample))  # at most ``sample`` rows, so it can go to every task
    drawn = cut(docs.select(F.col(DOC).cast("long").alias("d"), F.col(TEXT)).join(F.broadcast(chosen), F.col("d") == F.col("l")).select(TEXT, *HEADS))
    keys = [f"k{k}" for k in range(KEYS)]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([minimum_hashes(t) for t in texts_of(batch.column(TEXT))], dtype=np.int64).reshape(-1, KEYS)
            yield pa.RecordBatch.from_pydict({n: pa.array(own[:, k]) for k, n in enumerate(keys)})

    hashes = map_arrow(drawn, least, ", ".join(f"{k} long" for k in keys))
    # At most KEYS rows a sampled document.
    shared = hashes.select(F.explode(F.array(*keys)).alias("key")).groupBy("key").count().where("count > 1").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(shared.column("key").to_pylist(), shared.column("count").to_pylist())))

    names = [f"n{k}" for k in range(2 * len(HEADS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alike = sent.value
        counts: dict[int, list[float]] = {}
        for batch in batches:
            for text, *marks in zip(texts_of(batch.column(TEXT)), *(batch.column(h).to_pylist() for h in HEADS)):
                weight = 1 / max(alike.get(k, 1) for k in minimum_hashes(text))
                add = [weight * (mark is not None and (mark > 0) == high) for mark in marks for high in (False, True)]
                for f in [*features(text).tolist(), EVERY]:
                    own = counts.setdefault(f, [0.0] * len(add))
                    for k, x in enumerate(add):
                        own[k] += x
                if len(counts) > 500_000:
                    yield _counted(counts, names)
                    counts.clear()
        yield _counted(counts, names)

    summed = cut(map_arrow(drawn, run, "feature long, " + ", ".join(f"{n} double" for n in names)).groupBy("feature").agg(*[F.sum(n).alias(n) for n in names]))
    whole = summed.where(F.col("feature") == EVERY).first()
    totals = [whole[n] if whole else 0.0 for n in names]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = np.zeros((len(HEADS), batch.num_rows))
            for k in range(len(HEADS)):
                n0, n1 = totals[2 * k], totals[2 * k + 1]
                if not n0 or not n1:
                    continue
                c0, c1 = (batch.column(names[2 * k + x]).to_numpy() for x in (0, 1))
                w = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
                p = np.minimum((c0 + c1) / (n0 + n1), 1 - 1e-9)
                ratio = sum(_terms(c, n * p) + _terms(n - c, n * (1 - p)) for c, n in ((c0, n0), (c1, n1)))
                weights[k] = np.where(2 * ratio >= SIGNIFICANT**2, w, 0)
            at = np.flatnonzero(weights.any(axis=0) & (batch.column("feature").to_numpy() != EVERY))
            yield pa.RecordBatch.from_pydict({"feature": batch.column("feature").take(pa.array(at))} | {h: pa.array(weights[k, at]) for k, h in enumerate(HEADS)})

    # Only significant features come here: each is in several of the sampled documents.
    rows = map_arrow(summed, weigh, "feature long, " + ", ".join(f"{h} double" for h in HEADS)).orderBy("feature").toArrow()
    priors = np.array([np.log(totals[2 * k + 1] / totals[2 * k]) if totals[2 * k] and totals[2 * k + 1] else 0.0 for k in range(len(HEADS))])
    return priors, rows.column("feature").to_numpy(), np.stack([rows.column(h).to_numpy() for h in HEADS])


def _counted(counts: dict[int, list[float]], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*counts.values())) or [[]] * len(names)
    return pa.RecordBatch.from_pydict({"feature": pa.array(list(counts), pa.int64())} | {n: pa.array(c, pa.float64()) for n, c in zip(names, columns)})


def _terms(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)


def minimum_hashes(text: str) -> list[int]:
    """KEYS minima over the text's runs of five words, each under a hash of its own."""
    words = WORD.findall(text.lower())
    runs = {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    h = np.array([xxhash.xxh3_64_intdigest(x) for x in runs], dtype=np.uint64)
    return [int(mix64(h ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).min() >> np.uint64(1)) for k in range(KEYS)]


def evidence(docs: DataFrame, priors: np.ndarray, telling: np.ndarray, weights: np.ndarray) -> DataFrame:
    """doc_id, host, path, and log-odds and probability of each head from the text alone."""
    sent = docs.sparkSession.sparkContext.broadcast((priors, telling, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        priors, telling, weights = sent.value
        for batch in batches:
            for piece in slices(batch):
                found = [features(t) if t else np.zeros(0, dtype=np.int64) for t in texts_of(piece.column(TEXT))]
                odds = np.array([np.clip(priors + weights[:, np.isin(telling, f)].sum(axis=1), -8, 8) for f in found]).reshape(-1, len(HEADS))
                cols = {c: piece.column(c) for c in (DOC, "host", "path")}
                for k, h in enumerate(HEADS):
                    cols |= {f"{h}_odds": pa.array(odds[:, k]), f"{h}_p": pa.array(1 / (1 + np.exp(-odds[:, k])))}
                yield pa.RecordBatch.from_pydict(cols)

    return map_arrow(_sited(docs), run, f"{DOC} long, host string, path string, " + ", ".join(f"{h}_odds double, {h}_p double" for h in HEADS))


def _sited(docs: DataFrame) -> DataFrame:
    names = docs.columns
    if "url" in names:
        host, path = F.regexp_extract("url", r"^\w+://([^/?#]+)", 1), F.regexp_extract("url", r"^\w+://[^/?#]+/([^/?#]*)", 1)
    else:
        host, path = (F.col(c).cast("string") if c in names else F.lit(None).cast("string") for c in ("source", "lang"))
    return docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT), F.coalesce(F.concat(F.lit("="), host), F.lit("")).alias("host"), F.coalesce(F.concat(F.lit("="), path), F.lit("")).alias("path"))


def _strength(groups: DataFrame, head: str, above: str) -> float:
    """Pseudo-documents of the prior: from the groups' spread about what is above them, by moments."""
    mean = F.col(f"{head}_sum") / F.col("n")
    m = F.col(above)
    row = groups.agg(F.sum("n").alias("n"), F.sum(F.col("n") * (mean - m) ** 2).alias("spread"), F.sum(m * (1 - m)).alias("noise"), F.sum(F.col("n") * m * (1 - m)).alias("scale")).first()
    if not row["n"]:
        return MOST
    # Beta groups: spread = variance * n + what m (1 - m) gives each group by chance.
    between = max(0.0, row["spread"] - row["noise"]) / row["n"]
    whole = row["scale"] / row["n"]
    return float(np.clip(whole / between - 1, 1.0, MOST)) if between > 0 and whole > 0 else MOST


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """host, path and the posterior mean of each head there; and the global means."""
    sums = [F.count("*").alias("n"), *[F.sum(f"{h}_p").alias(f"{h}_sum") for h in HEADS]]
    paths = cut(scored.groupBy("host", "path").agg(*sums))
    add = [F.sum("n").alias("n"), *[F.sum(f"{h}_sum").alias(f"{h}_sum") for h in HEADS]]
    hosts = paths.groupBy("host").agg(*add)
    whole = paths.agg(*add).first()
    means = {h: min(max((whole[f"{h}_sum"] or 0) / whole["n"], 1e-4), 1 - 1e-4) if whole["n"] else 0.5 for h in HEADS}
    for h in HEADS:
        hosts = hosts.withColumn(f"{h}_above", F.lit(means[h]))
        m = _strength(hosts, h, f"{h}_above")
        hosts = hosts.withColumn(f"{h}_host", (F.col(f"{h}_sum") + m * F.col(f"{h}_above")) / (F.col("n") + m))
    sites = paths.join(hosts.select("host", *[f"{h}_host" for h in HEADS]), "host")
    sites = cut(sites)
    for h in HEADS:
        m = _strength(sites, h, f"{h}_host")
        sites = sites.withColumn(f"{h}_site", (F.col(f"{h}_sum") + m * F.col(f"{h}_host")) / (F.col("n") + m))
    return sites.select("host", "path", *[f"{h}_site" for h in HEADS]), means


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, quality and toxicity: own probabilities, site posteriors, posteriors; kept if good and not toxic."""
    scored = cut(evidence(docs, *fit(docs, labels, sample)))
    sites, means = site_posteriors(scored)
    spread = sites.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    joined = scored.withColumn("salt", F.pmod(F.xxhash64(DOC), F.lit(SALT)).cast("int")).join(spread, ["host", "path", "salt"])
    cols = [F.col(DOC)]
    for h in HEADS:
        p = F.least(F.greatest(F.col(f"{h}_site"), F.lit(1e-4)), F.lit(1 - 1e-4))
        shift = F.ln(p / (1 - p)) - float(np.log(means[h] / (1 - means[h])))
        odds = F.col(f"{h}_odds") + shift
        cols += [F.col(f"{h}_p").alias(f"{h}_document"), F.col(f"{h}_site"), (1 / (1 + F.exp(-odds))).alias(f"{h}_posterior")]
    return joined.select(*cols).withColumn("kept", (F.col("quality_posterior") >= 0.5) & (F.col("toxic_posterior") < 0.5))
