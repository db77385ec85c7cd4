"""Secret scans: three base patterns, and formats learnt by grammar inference.

Labelled credentials of each format make a prefix tree.  Its states are
merged where their outgoing frequencies are statistically compatible (a
Hoeffding bound on every symbol and on ending, checked down the tree), which
leaves a probabilistic automaton.  Others are inferred in the same way from
labelled ordinary strings (identifiers, paths, class names, numbers, UUIDs,
encoded data) and from at most ``WORDS`` long words of the corpus, those of the
least hash; these are smoothed by how often each symbol occurs.  Every
candidate, any run of credential characters of ``LEAST`` or more, is scored by
its greatest log-likelihood under a format less the greatest under an ordinary
automaton, per character; an automaton reads strings of about its examples'
lengths that have the symbols which all of these have.  From ``THRESHOLD`` on a candidate is a span of the kind of
its best format, beside the base spans that it may overlap.

The labelled strings are made up by ``labelled``, with a fixed seed, from
publicly known formats; any others can be passed.  A long word is a run of
letters all in lower case, or all but the first, or all in upper case.  Null and
empty texts have no spans.  Rows are independent but for these words.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOC, TEXT, map_arrow, slices, texts_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
LEAST, THRESHOLD, ALPHA, FLOOR, SMOOTH, WORDS = 16, 0.75, 0.05, math.log(1e-4), 0.1, 3_000
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
LONG_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+")
#: Candidates whose score a worker remembers; this changes speed only.
REMEMBERED = 200_000

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled(each: int = 150, seed: int = 7) -> dict[str, list[str]]:
    """Made-up credentials by format, and ordinary strings, whose kinds begin with ``plain``."""
    r = random.Random(seed)

    def of(alphabet: str, n: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(n))

    word = _UPPER + _LOWER + _DIGIT
    parts = "the and tion er in th ou re st on an at en ing ed or ea ti es ar le ha wh ly sh ble for co de ma pro con ter ver ent al is to be un heit keit ung lich sch ein ge zu aux eau eux ment elle cion ado mente que ez os".split()
    terms = "user account manager factory service request response data source file path config build test main index page image view list item node key value token type name list load save read write parse core util common internal client server http json model table row column abstract default base simple handler provider builder adapter exception error".split()

    def name(low: int, high: int) -> str:
        return "".join(r.choice(parts) for _ in range(r.randint(low, high)))

    def joined(separators: str, low: int, high: int, some: list[str] = terms) -> str:
        s = r.choice(separators)
        return s.join(r.choice(some) if r.random() < 0.8 else name(1, 4) for _ in range(r.randint(low, high)))

    def long(make: Callable[[], str]) -> str:
        text = make()
        while len(text) < LEAST:
            text += make()
        return text

    def camel() -> str:
        return "".join(x.capitalize() for x in r.choices(terms, k=r.randint(2, 6)))

    def hexes(*sizes: int) -> str:
        return "-".join(of(_DIGIT + "abcdef", n) for n in sizes)

    makers = {
        "cloud_key": lambda: "AKIA" + of(_UPPER + _DIGIT, 16),
        "hex_key": lambda: of(_DIGIT + "abcdef", r.choice((32, 40, 64))),
        "upper_hex_key": lambda: of(_DIGIT + "ABCDEF", r.choice((32, 40, 64))),
        "forge_token": lambda: r.choice(("ghp_", "gho_", "ghs_")) + of(word, 36),
        "chat_token": lambda: r.choice(("xoxb-", "xoxp-")) + of(_DIGIT, 12) + "-" + of(_DIGIT, 12) + "-" + of(word, 24),
        "payment_key": lambda: r.choice(("sk_live_", "rk_live_")) + of(word, 24),
        "map_key": lambda: "AIza" + of(word + "_-", 35),
        "web_token": lambda: "eyJ" + of(word, 30) + "." + of(word + "_-", 60) + "." + of(word + "_-", 43),
        "base64_key": lambda: of(word + "+/", 43) + "=",
        "plain_word": lambda: (lambda x: x.capitalize() if r.random() < 0.3 else x.upper() if r.random() < 0.1 else x)(long(lambda: name(2, 5))),
        "plain_joined": lambda: long(lambda: joined("_-.", 2, 6) + (r.choice("_-.") + of(_DIGIT, r.randint(1, 4)) if r.random() < 0.3 else "")),
        "plain_upper": lambda: long(lambda: joined("_-", 2, 6)).upper(),
        "plain_path": lambda: long(lambda: r.choice(("/", "", "../", "www.")) + joined("/", 2, 6) + r.choice(("", ".html", ".py", ".jpg", "/", f"-{r.randint(1, 99)}"))),
        "plain_class": lambda: long(lambda: joined(".", 1, 4) + "." + camel()) if r.random() < 0.7 else long(camel),
        "plain_number": lambda: long(lambda: r.choice((of(_DIGIT, r.randint(1, 20)), "2024-01-02", "1.", "10.0.0.1", "-"))),
        "plain_line": lambda: r.choice("=-_.+/") * r.randint(LEAST, 80),
        "plain_uuid": lambda: hexes(8, 4, 4, 4, 12) if r.random() < 0.8 else hexes(8, 4, 4, 4, 12).upper(),
        "plain_data": lambda: of(word + "+/", r.randint(200, 900)) + r.choice(("", "=", "==")),
    }
    return {k: [f() for _ in range(each if k != "plain_data" else each // 5)] for k, f in makers.items()}


class Automaton:
    """A probabilistic automaton: for each state, symbol -> (log-probability, next state)."""

    def __init__(self, steps: list[dict[str, tuple[float, int]]], ends: list[float], strings: list[str] = ()):
        self.steps, self.ends = steps, ends
        sizes = [len(s) for s in strings] or [0]
        #: It reads strings of about the lengths of its examples that have the symbols which all of these have.
        self.least, self.most = 0.75 * min(sizes), 1.5 * max(sizes) if strings else math.inf
        self.needed = frozenset.intersection(*map(frozenset, strings)) if strings else frozenset()

    def reads(self, text: str) -> bool:
        return self.least <= len(text) <= self.most and self.needed <= frozenset(text)

    def smoothed(self, strings: list[str]) -> Automaton:
        """With a share ``SMOOTH`` of every step left to the symbols as often as the strings have them; an unseen one stays."""
        counts = Counter(c for s in strings for c in s)
        total = sum(counts.values())
        steps = []
        for k, own in enumerate(self.steps):
            known = {c: (math.log((1 - SMOOTH) * math.exp(p) + SMOOTH * counts[c] / total), to) for c, (p, to) in own.items()}
            steps.append({c: (math.log(SMOOTH * n / total), k) for c, n in counts.items()} | known)
        return Automaton(steps, self.ends, strings)

    def log_likelihood(self, text: str, floor: float = FLOOR) -> float:
        state, total = 0, 0.0
        steps = self.steps
        for c in text:
            found = steps[state].get(c)
            if found is None:
                total += floor  # and stay: one unseen symbol doesn't end the reading
            else:
                total += found[0]
                state = found[1]
        return total + max(self.ends[state], floor)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the strings' prefix tree, breadth first."""
    children: list[dict[str, int]] = [{}]
    through: list[int] = [0]
    ending: list[int] = [0]
    passed: list[dict[str, int]] = [defaultdict(int)]
    for s in strings:
        at = 0
        through[0] += 1
        for c in s:
            passed[at][c] += 1
            if (to := children[at].get(c)) is None:
                to = children[at][c] = len(children)
                children.append({})
                through.append(0)
                ending.append(0)
                passed.append(defaultdict(int))
            at = to
            through[at] += 1
        ending[at] += 1
    slack = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > slack * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if not through[x] or not through[y]:
                continue
            if differ(ending[x], through[x], ending[y], through[y]):
                return False
            for c in passed[x].keys() | passed[y].keys():
                if differ(passed[x].get(c, 0), through[x], passed[y].get(c, 0), through[y]):
                    return False
            todo += [(children[x][c], children[y][c]) for c in children[x].keys() & children[y].keys() if children[x][c] != children[y][c] and children[y][c] not in red]
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            through[x] += through[y]
            ending[x] += ending[y]
            for c, n in passed[y].items():
                passed[x][c] += n
            for c, to in children[y].items():
                if c in children[x]:
                    todo.append((children[x][c], to))
                else:
                    children[x][c] = to

    red: dict[int, None] = {0: None}
    blue = [(0, c) for c in children[0]]
    while blue:
        # The heaviest edge first: its frequencies are the surest.
        blue.sort(key=lambda e: passed[e[0]][e[1]])
        source, symbol = blue.pop()
        state = children[source][symbol]
        if state in red:
            continue
        for r in red:
            if compatible(r, state):
                children[source][symbol] = r
                fold(r, state)
                break
        else:
            red[state] = None
        blue = list(dict.fromkeys((r, c) for r in red for c, to in children[r].items() if to not in red))
    number = {s: k for k, s in enumerate(red)}
    steps, ends = [], []
    for s in red:
        total = through[s] + 0.01
        steps.append({c: (math.log(passed[s][c] / total), number[to]) for c, to in children[s].items() if passed[s][c]})
        ends.append(math.log(max(ending[s], 1e-3) / total))
    return Automaton(steps, ends, strings)


class Scorer:
    def __init__(self, examples: dict[str, list[str]] | None = None, words: list[str] = (), threshold: float = THRESHOLD):
        examples = dict(examples or labelled())
        if words:
            examples["plain_corpus"] = list(words)
        self.plain = [infer(v).smoothed(v) for k, v in examples.items() if k.startswith("plain")]
        self.formats = {k: infer(v) for k, v in examples.items() if not k.startswith("plain")}
        self.threshold = threshold
        self.known: dict[str, tuple[float, str]] = {}

    def best(self, text: str) -> tuple[float, str]:
        """Log-likelihood ratio per character, and the format that has it."""
        if (found := self.known.get(text)) is None:
            plain = max((a.log_likelihood(text) for a in self.plain if a.reads(text)), default=FLOOR * len(text))
            score, kind = max(((a.log_likelihood(text), k) for k, a in self.formats.items() if a.reads(text)), default=(-math.inf, ""))
            found = (score - plain) / len(text), kind
            if len(self.known) < REMEMBERED and len(text) < 100:
                self.known[text] = found
        return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end, kind), of whole matches, ordered."""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out)


def spans(text: str, scorer: Scorer) -> tuple[list, list]:
    base = base_spans(text)
    added = []
    for m in CANDIDATE.finditer(text):
        score, kind = scorer.best(m[0])
        if score >= scorer.threshold:
            added.append((m.start(), 3, m.end(), kind))
    return base, sorted(base + added)


def joined(found: list) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in found)


def long_words(docs: DataFrame, most: int = WORDS) -> list[str]:
    """At most so many of the corpus's distinct long words, those of the least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                own = {w for t in texts_of(piece.column(TEXT)) for w in CANDIDATE.findall(t) if len(w) < 100 and LONG_WORD.fullmatch(w)}
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(own), pa.string())})

    words = map_arrow(docs.select(F.col(TEXT)), run, "word string").distinct()
    return [x["word"] for x in words.orderBy(F.xxhash64("word"), "word").limit(most).collect()]


def find_secrets(docs: DataFrame, examples: dict[str, list[str]] | None = None, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added.

    The automata are inferred on the driver from the labelled strings and words
    (at most some thousands) and sent with the task.
    """
    scorer = Scorer(examples, long_words(docs, words) if words else (), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for text in texts_of(piece.column(TEXT)):
                    base, whole = spans(text, scorer)
                    kinds = [x[3] for x in base]
                    rows.append([kinds.count(k) for k in KINDS] + [hashlib.sha256(joined(base).encode()).hexdigest(), joined(whole), len(whole) - len(base)])
                cols = list(zip(*rows)) if rows else [[]] * 6
                types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"]
                yield pa.RecordBatch.from_pydict({DOC: piece.column(DOC)} | {n: pa.array(c, t) for n, c, t in zip(names, cols, types)})

    return map_arrow(docs.select(F.col(DOC).cast("long").alias(DOC), F.col(TEXT)), run, f"{DOC} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
