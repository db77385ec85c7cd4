"""Quality rules: simple counts, and perplexity under a Kneser-Ney model of each language.

The model is over characters, folded to ``SYMBOLS`` symbols of the language's
own: space, digits, stops, four kinds of other signs, and its letters (lower case), of which
the most frequent ``OWN`` have a symbol each and all others are spelled, by
rank: one of the symbols left over says how many follow (``FOLLOW``), and these
tell the letter.  So each letter of any script is told from all others, and
entropy is that of the spelled text by its characters.  A language has at most
SYMBOLS**4 n-grams
of order 4, however large the corpus: counts, model and what a worker maps all
have that bound.  Counting covers every character of every document: workers
count densely, Spark adds up per (language, n-gram).  One task for each
language then makes the modified Kneser-Ney model (three discounts an order,
continuation counts below the top) and stores it as arrays sorted by the
n-gram's hash: log-probability, and back-off weight of the n-gram as a context.
Workers map the arrays and search them.

A last pass takes each language's quartiles of cross-entropy over all its
documents; the band reaches from the median ``WIDTH[0]`` inter-quartile ranges
(of ``LEAST_RANGE`` bits at least) down and ``WIDTH[1]`` up, and is wider for
short texts, whose entropy scatters: both are divided by the square root of
n / (n + 200).  So both bounds lie between the usual fences for outliers (2
ranges from the median) and for far outliers (3.5).

Null texts count as empty, which the base rule rejects.  A null language is
one of its own, and so are all documents of a table without ``lang``.  A
language without characters, or a table without rows, makes no model: such
documents have no verdict beside the base rule's.  Repeated rows count as often
as they occur.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import importable
from .common import DOC, TEXT, cut, map_arrow, mix64, release, shared_folder, slices, texts_of, trim

SYMBOLS, OWN, ORDER, WIDTH, LEAST_RANGE = 43, 30, 4, (2.5, 2.5), 0.03
SPACE, DIGIT, STOP, SIGN, LETTER = 0, 1, 2, 3, 7
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SIGNS = "#*$%&|<>"
#: For each symbol that begins a spelled letter, how many symbols follow, and the rank beyond OWN of the first letter spelled with it.
FOLLOW = np.array([1, 1, 1, 1, 2, 4])
_LETTERS = SYMBOLS - LETTER
_FIRST = np.concatenate(([0], np.cumsum(_LETTERS**FOLLOW)[:-1]))
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)
_CACHE: dict = {}


def forget_memory() -> None:
    _CACHE.pop("folder", None)
    _CACHE.pop("scores", None)


# -- base features ---------------------------------------------------------------------------------------------------


def words_of(text: str) -> tuple[list[str], int]:
    """Words between blanks and the characters 9 to 13, and their code points in all."""
    for c in "\t\n\v\f\r":
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w], len(text) - text.count(" ")


def repeated_words(lists: list[list[str]], window: int = 5) -> np.ndarray:
    """For each text, the words that lie in a window which occurs twice or more in that text."""
    sizes = np.array([len(x) for x in lists], dtype=np.int64)
    total = int(sizes.sum())
    out = np.zeros(len(lists), dtype=np.int64)
    if total < window:
        return out
    h = np.fromiter((hash(w) for x in lists for w in x), dtype=np.int64, count=total).view(np.uint64)
    doc = np.repeat(np.arange(len(lists)), sizes)
    n = total - window + 1
    with np.errstate(over="ignore"):
        key = mix64(doc[:n].astype(np.uint64) + np.uint64(1))
        for k in range(window):
            key = key + mix64(h[k : k + n] ^ _POWERS[k])
    valid = np.flatnonzero(doc[:n] == doc[window - 1 :])
    order = valid[np.argsort(key[valid], kind="stable")]
    if not len(order):
        return out
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(total + 1, dtype=np.int64)
    at = order[twice]
    edge[: n] += np.bincount(at, minlength=n)
    edge[window : n + window] -= np.bincount(at, minlength=n)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=len(lists)).astype(np.int64)


def features(texts: list[str]) -> dict[str, np.ndarray]:
    lists, chars = zip(*map(words_of, texts)) if texts else ((), ())
    dup = []
    for t in texts:
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.array([len(x) for x in lists], dtype=np.int64),
        "word_chars": np.array(chars, dtype=np.int64),
        "n_symbols": np.array([sum(t.count(c) for c in SIGNS) for t in texts], dtype=np.int64),
        "n_dup_lines": np.array(dup, dtype=np.int64),
        "n_repeat_words": repeated_words(list(lists)),
    }


def base_failed(f: dict[str, np.ndarray]) -> np.ndarray:
    return (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])


# -- symbols and n-grams -----------------------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Code point -> SPACE, DIGIT, STOP or one of four from SIGN on, or LETTER and more: LETTER + the code point in lower case."""
    if (found := _CACHE.get("classes")) is None:
        found = SIGN + np.arange(0x110000, dtype=np.int32) % 4
        for cp in range(0x110000):
            c = chr(cp)
            if c.isspace():
                found[cp] = SPACE
            elif c.isdigit():
                found[cp] = DIGIT
            elif c in ".,;:?!'\"()-":
                found[cp] = STOP
            elif c.isalpha():
                low = c.lower()
                found[cp] = LETTER + (ord(low) if len(low) == 1 else cp)
        _CACHE["classes"] = found
    return found


def alphabet(code_points: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Symbols of all code points, by how often a language has each of them; SYMBOLS and more for letters to be spelled."""
    classes = _classes()
    own = classes[code_points]
    letters, back = np.unique(own[own >= LETTER], return_inverse=True)
    counts = np.bincount(back, weights=n[own >= LETTER], minlength=len(letters))
    rank = np.empty(len(letters), dtype=np.int64)
    rank[np.lexsort((letters, -counts))] = np.arange(len(letters))
    last = SYMBOLS + max(0, len(letters) - OWN)
    table = np.full(0x110000 + LETTER, SYMBOLS - 1, dtype=np.min_scalar_type(last))
    table[:LETTER] = np.arange(LETTER)
    table[letters] = np.where(rank < OWN, LETTER + rank, SYMBOLS + rank - OWN)
    return table[classes]


def spelled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols, with those of SYMBOLS and more spelled, and how many each has become."""
    size = np.ones(len(s), dtype=np.int64)
    far = np.flatnonzero(s >= SYMBOLS)
    if not len(far):
        return s, size
    rank = s[far].astype(np.int64) - SYMBOLS
    begin = np.searchsorted(_FIRST, rank, side="right") - 1
    follow = FOLLOW[begin]
    size[far] += follow
    out = np.repeat(s, size)
    at = np.cumsum(size)[far] - 1
    out[at - follow] = LETTER + OWN + begin
    rank -= _FIRST[begin]
    for k in range(int(follow.max())):
        some = follow > k
        out[at[some] - k] = LETTER + rank[some] // _LETTERS**k % _LETTERS
    return out, size


def _code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype="<u4")


def grams(texts: list[str], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order-4 n-gram that ends at each symbol of each text, and how many symbols each text has; texts begin after spaces."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    gap = ORDER - 1
    s, each = spelled(symbols[_code_points([" " * gap, (" " * gap).join(texts)])])
    s = s.astype(np.uint32)
    if len(s) > len(each):
        ends, before = np.cumsum(sizes + gap), np.concatenate(([0], np.cumsum(each)))
        sizes = before[ends] - before[ends - sizes]
    code = s[gap:].copy()
    for k in range(1, ORDER):
        code += s[gap - k : len(s) - k] * np.uint32(SYMBOLS**k)
    starts = np.cumsum(sizes + gap) - sizes - gap
    keep = np.ones(len(code), dtype=bool)
    for k in range(gap):
        own = starts[1:] - gap + k
        keep[own] = False
    return code[keep], sizes


def _language(batch: pa.RecordBatch) -> list[str]:
    return ["" if x is None else f"={x}" for x in batch.column("lang").to_pylist()]


def _by_language(langs: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, x in enumerate(langs):
        out.setdefault(x, []).append(k)
    return out


def _counted(docs: DataFrame, size: int, numbers: Callable[[str, list[str]], np.ndarray]) -> DataFrame:
    """lang, number, n of the numbers below ``size`` that all documents' texts have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "number": pa.array(at.astype(np.int32)), "n": pa.array(n[at])})
            held.clear()

        for batch in batches:
            for piece in slices(batch):
                texts = texts_of(piece.column(TEXT))
                for lang, rows in _by_language(_language(piece)).items():
                    if lang not in held and len(held) >= 8:
                        yield from flush()
                    own = held.setdefault(lang, np.zeros(size, dtype=np.int64))
                    own += np.bincount(numbers(lang, [texts[k] for k in rows]), minlength=size)
        yield from flush()

    counted = map_arrow(_with_language(docs).select(TEXT, "lang"), count, "lang string, number int, n long")
    return counted.groupBy("lang", "number").agg(F.sum("n").alias("n"))


def _with_language(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT), lang.alias("lang"))


# -- the model -----------------------------------------------------------------------------------------------------------


def _keys(order: int, code: np.ndarray) -> np.ndarray:
    return mix64(code.astype(np.uint64) | np.uint64(order << 40))


def kneser_ney(gram: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays sorted by key: log2 probability of each n-gram seen, and log2 back-off weight of each context seen."""
    counts = {ORDER: (gram.astype(np.int64), n.astype(np.int64))}
    for order in range(ORDER - 1, 0, -1):
        # Continuation counts: in how many different n-grams one symbol longer it is the end.
        longer = counts[order + 1][0]
        code, c = np.unique(longer % SYMBOLS**order, return_counts=True)
        counts[order] = (code, c.astype(np.int64))
    prob: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    keys, logp, ckeys, clog = [], [], [], []
    for order in range(1, ORDER + 1):
        code, c = counts[order]
        t = [max(1, int((c == k).sum())) for k in (1, 2, 3, 4)]
        y = t[0] / (t[0] + 2 * t[1])
        d = np.clip([0.0, 1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1], 3 - 4 * y * t[3] / t[2]], [0, 0.1, 0.1, 0.1], [0, 0.9, 1.9, 2.9])
        cut_ = d[np.minimum(c, 3)]
        context = code // SYMBOLS
        own, back = np.unique(context, return_inverse=True)
        total = np.bincount(back, weights=c)
        left = np.bincount(back, weights=cut_) / total
        if order == 1:
            lower = np.full(len(code), 1 / SYMBOLS)
        else:
            lcode, lp = prob[order - 1]
            lower = lp[np.searchsorted(lcode, code % SYMBOLS ** (order - 1))]
        p = (c - cut_) / total[back] + left[back] * lower
        prob[order] = (code, p)
        keys.append(_keys(order, code))
        logp.append(np.log2(p))
        ckeys.append(_keys(order, own))
        clog.append(np.log2(left))
    out = {}
    for names, k, v in ((("keys", "logp"), keys, logp), (("ckeys", "clog"), ckeys, clog)):
        k, v = np.concatenate(k), np.concatenate(v).astype(np.float32)
        at = np.argsort(k)
        out |= {names[0]: k[at], names[1]: v[at]}
    return out


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


def log_probabilities(model: dict[str, np.ndarray], code: np.ndarray) -> np.ndarray:
    """log2 of the probability of the last symbol of each order-4 n-gram after the other three."""
    out = np.zeros(len(code), dtype=np.float32)
    todo = np.arange(len(code))
    for order in range(ORDER, 0, -1):
        own = code[todo].astype(np.int64) % SYMBOLS**order
        there, p = _find(model["keys"], model["logp"], _keys(order, own))
        out[todo[there]] += p[there]
        todo, own = todo[~there], own[~there]
        there, weight = _find(model["ckeys"], model["clog"], _keys(order, own // SYMBOLS))
        out[todo[there]] += weight[there]
    out[todo] -= np.log2(SYMBOLS)
    return out


def _place(folder: str, lang: str) -> str:
    return os.path.join(folder, "lang" + quote(lang, safe=""))


def _store(folder: str, lang: str, arrays: dict[str, np.ndarray]) -> None:
    """Under a name of its own, then renamed: a task that runs twice does no harm."""
    for name, x in arrays.items():
        os.makedirs(_place(folder, lang), exist_ok=True)
        own = os.path.join(_place(folder, lang), f"{name}.{os.getpid()}.{os.urandom(4).hex()}.npy")
        np.save(own, x)
        os.replace(own, os.path.join(_place(folder, lang), f"{name}.npy"))


def _load(folder: str, lang: str, *names: str) -> dict[str, np.ndarray] | None:
    where = _place(folder, lang)
    if not all(os.path.exists(os.path.join(where, f"{n}.npy")) for n in names):
        return None
    return {n: np.load(os.path.join(where, f"{n}.npy"), mmap_mode="r") for n in names}


class _Scores:
    """log2 probabilities of a language by n-gram, searched for when first met."""

    def __init__(self, folder: str):
        self.folder = folder
        self.of: dict[str, tuple | None] = {}

    def entropy(self, lang: str, texts: list[str]) -> np.ndarray:
        """Bits per character of each text; NaN without a model or without characters."""
        if lang not in self.of:
            if len(self.of) >= 8:
                self.of.clear()
            model = _load(self.folder, lang, "keys", "logp", "ckeys", "clog", "alphabet")
            self.of[lang] = model and (model, np.full(SYMBOLS**ORDER, np.nan, dtype=np.float32))
        out = np.full(len(texts), np.nan)
        if self.of[lang] is None:
            return out
        model, known = self.of[lang]
        code, sizes = grams(texts, model["alphabet"])
        p = known[code]
        new = np.isnan(p)
        if new.any():
            fresh = np.unique(code[new])
            known[fresh] = log_probabilities(model, fresh)
            p = known[code]
        ends = np.concatenate(([0.0], np.cumsum(p, dtype=np.float64)))
        at = np.concatenate(([0], np.cumsum(sizes)))
        chars = np.array([len(t) for t in texts], dtype=np.int64)
        some = chars > 0
        out[some] = -(ends[at[1:]] - ends[at[:-1]])[some] / chars[some]
        return out


def _scores(folder: str) -> _Scores:
    if _CACHE.get("folder") != folder:
        _CACHE["folder"], _CACHE["scores"] = folder, _Scores(folder)
    return _CACHE["scores"]


def entropies(folder: str, texts: list[str], langs: list[str]) -> np.ndarray:
    out = np.full(len(texts), np.nan)
    for lang, rows in _by_language(langs).items():
        out[rows] = _scores(folder).entropy(lang, [texts[k] for k in rows])
    return out


def within_band(folder: str, langs: list[str], bits: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """True where no band is known."""
    out = np.ones(len(langs), dtype=bool)
    for lang, rows in _by_language(langs).items():
        if (band := _load(folder, lang, "band")) is not None:
            middle, below, above = band["band"]
            n = np.maximum(chars[rows], 1)
            away = (bits[rows] - middle) * np.sqrt(n / (n + 200.0))
            out[rows] = np.isnan(away) | ((away >= -below) & (away <= above))
    return out


def fit(docs: DataFrame, width: tuple[float, float] = WIDTH) -> str:
    """Count, make the models and bands, and return the shared folder that holds them."""
    folder = shared_folder(docs.sparkSession, "perplexity")

    def letters(t: pa.Table) -> pa.Table:
        _store(folder, t.column("lang")[0].as_py(), {"alphabet": alphabet(t.column("number").to_numpy(), t.column("n").to_numpy())})
        return t.select(["lang"])[:1]

    def build(t: pa.Table) -> pa.Table:
        at = np.argsort(t.column("number").to_numpy())
        _store(folder, t.column("lang")[0].as_py(), kneser_ney(t.column("number").to_numpy()[at], t.column("n").to_numpy()[at]))
        return t.select(["lang"])[:1]

    def numbers(lang: str, texts: list[str]) -> np.ndarray:
        own = _load(folder, lang, "alphabet")
        return grams(texts, own["alphabet"])[0] if own else np.zeros(0, dtype=np.uint32)

    importable(docs.sparkSession)
    # A language's group has at most as many rows as there are characters, or n-grams of symbols.
    cut(_counted(docs, 0x110000, lambda _, texts: _code_points(texts)).groupBy("lang").applyInArrow(letters, "lang string"))
    cut(_counted(docs, SYMBOLS**ORDER, numbers).groupBy("lang").applyInArrow(build, "lang string"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=4_000_000):
                texts, langs = texts_of(piece.column(TEXT)), _language(piece)
                yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "bits": pa.array(entropies(folder, texts, langs), from_pandas=True), "chars": pa.array([len(t) for t in texts], pa.int64())})

    scored = map_arrow(_with_language(docs).select(TEXT, "lang"), score, "lang string, bits double, chars long")
    quartiles = scored.where("bits is not null").groupBy("lang").agg(F.percentile_approx("bits", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias("q"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, m, b = row["q"]
                _store(folder, row["lang"], {"band": np.array([m, *(w * max(b - a, LEAST_RANGE) for w in width)])})
            yield batch.select(["lang"])

    cut(map_arrow(quartiles, keep, "lang string"))
    return folder


def _verdict(folder: str, texts: list[str], langs: list[str], f: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bits = entropies(folder, texts, langs)
    failed = base_failed(f)
    chars = np.array([len(t) for t in texts], dtype=np.int64)
    return failed, ~failed & within_band(folder, langs, bits, chars), bits


def quality_rules(docs: DataFrame, width: tuple[float, float] = WIDTH) -> DataFrame:
    """doc_id, the base features, base_failed, kept, and perplexity (null without a model)."""
    folder = fit(docs, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=4_000_000):
                texts, langs = texts_of(piece.column(TEXT)), _language(piece)
                f = features(texts)
                failed, kept, bits = _verdict(folder, texts, langs, f)
                yield pa.RecordBatch.from_pydict({DOC: piece.column(DOC)} | {k: pa.array(f[k]) for k in FEATURES} | {"base_failed": pa.array(failed), "kept": pa.array(kept), "perplexity": pa.array(2.0**bits, from_pandas=True)})

    schema = f"{DOC} long, " + ", ".join(f"{k} long" for k in FEATURES) + ", base_failed boolean, kept boolean, perplexity double"
    return map_arrow(_with_language(docs), run, schema)


def keep_good(docs: DataFrame, width: tuple[float, float] = WIDTH) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    folder = fit(docs, width)
    importable(docs.sparkSession)

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array) -> pa.Array:
        release(__name__)
        out = [np.zeros(0, dtype=bool)]
        for piece in slices(pa.RecordBatch.from_arrays([text, lang], [TEXT, "lang"]), most=4_000_000):
            texts, langs = texts_of(piece.column(TEXT)), _language(piece)
            out.append(_verdict(folder, texts, langs, features(texts))[1])
        trim()
        return pa.array(np.concatenate(out))

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.where(kept(F.col(TEXT), lang))
