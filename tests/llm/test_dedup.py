import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specframe.llm import decontaminate, line_dedup, near_dedup

REPO = Path(__file__).resolve().parents[2]


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(n)]


def edited(r, ws, n):
    ws = list(ws)
    for _ in range(n):
        k = r.randrange(len(ws))
        how = r.random()
        if how < 0.4:
            ws[k] = "edit" + str(r.randrange(1000))
        elif how < 0.7:
            ws.insert(k, "more" + str(r.randrange(1000)))
        elif len(ws) > 1:
            del ws[k]
    return ws


# -- near duplicates ---------------------------------------------------------------------------------------------------


def test_samples_collide_as_often_as_documents_are_similar():
    r = random.Random(1)
    idf = near_dedup.Idf(np.zeros(near_dedup.SKETCH), 1000)
    hit, expected = [], []
    for _ in range(60):
        ws = words(r, 200)
        a, b = near_dedup.shingles([ws, edited(r, ws, 6)])
        expected.append(near_dedup.weighted_jaccard(*a, *b, idf) ** near_dedup.ROWS)
        hit.append((near_dedup.signature(a[0], idf.weights(*a)) == near_dedup.signature(b[0], idf.weights(*b))).mean())
    assert abs(np.mean(hit) - np.mean(expected)) < 0.05


def test_pruned_samples_are_the_full_ones():
    """The certificate of the smallest variates against plain minima over all shingles."""
    r = random.Random(2)
    idf = near_dedup.Idf(np.zeros(near_dedup.SKETCH), 1000)
    for n, times in ((300, 1), (90, 40), (3000, 1), (6, 1)):
        ((s, count),) = near_dedup.shingles([words(r, n) * times])
        weights = idf.weights(s, count)
        near_dedup._variates()
        mult, add = near_dedup._CACHE["hashes"]
        wide = near_dedup.mix64(s.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
        with np.errstate(over="ignore"):
            rows = [near_dedup._values((wide ^ x) * m, np.log(weights)) for m, x in zip(mult, add)]
            one = np.array([near_dedup.mix64(wide[[a.argmin()]] ^ near_dedup.mix64(t[[a.argmin()]].astype(np.uint64) + np.uint64(77)))[0] for a, t in rows], dtype=np.uint64).reshape(near_dedup.BANDS, near_dedup.ROWS)
            key = np.arange(1, near_dedup.BANDS + 1, dtype=np.uint64)
            for k in range(near_dedup.ROWS):
                key = near_dedup.mix64(key * np.uint64(0x9E3779B97F4A7C15) + one[:, k])
        assert (near_dedup.signature(s, weights) == key.view(np.int64)).all()


def test_classes_against_brute_force(spark):
    r = random.Random(3)
    base = [words(r, r.choice((30, 80, 400))) for _ in range(25)]
    docs = [" ".join(ws) for ws in base]
    docs += [" ".join(edited(r, ws, r.choice((0, 1, 2, 4)))) for ws in base for _ in range(4)]
    docs += [" ".join(edited(r, base[0], 1)) for _ in range(60)]  # one large group
    docs += ["short text", "Short  text", None, "", "one two three four five six " * 400]
    long = words(r, 30_000)
    docs += [" ".join(long), " ".join(edited(r, long, 200))]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)] + [(7, docs[7])], "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS node", *(f"3 AS {n}" for n in ("__doc", "__th", "doc", "th", "_doc", "class", "key")))
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == len(docs) + 1
    cls = {x.doc_id: x.class_id for x in got}
    # The sketch's counters are nearly empty here, so frequencies are exact in the end; similarity by definition.
    lists = [near_dedup.words_of(t or "") for t in docs]
    sets = near_dedup.shingles(lists)
    df_of = {}
    for s, _ in sets:
        for x in set((s & np.uint32(near_dedup.SKETCH - 1)).tolist()):
            df_of[x] = df_of.get(x, 0) + 1
    counts = np.zeros(near_dedup.SKETCH)
    for x, n in df_of.items():
        counts[x] = n
    idf = near_dedup.Idf(counts, sum(len(s) > 0 for s, _ in sets) + 1)
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if lists[a] == lists[b] or lists[a] and lists[b] and near_dedup.weighted_jaccard(*sets[a], *sets[b], idf) >= 0.8:
                parent[find(a)] = find(b)
    expected = {}
    for k in range(len(docs)):
        expected.setdefault(find(k), []).append(k)
    # Bands find a pair of similarity 0.8 with probability 0.998; of classes at most one may differ.
    assert len({frozenset(v) for v in expected.values()} ^ {frozenset(k for k in cls if cls[k] == c) for c in set(cls.values())}) <= 3
    assert cls[185] == cls[186] and cls[187] == cls[188]
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and {tuple(x)[2:] for x in kept.collect()} == {(1, 2, *[3] * 7)}
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(cls.values()))
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0 and near_dedup.keep_one(df.limit(0)).count() == 0


def test_unlike_members_of_a_bucket_stay_in_their_task(spark, monkeypatch):
    r = random.Random(8)
    base = words(r, 150)
    docs = [" ".join(edited(r, base, n)) for n in [6] * 120 + [1] * 40]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    verified, pairs = near_dedup._verified, []

    def counted(found, *others):
        found = near_dedup.cut(found)
        pairs.append(found.count())
        return verified(found, *others)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    whole = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()}
    # Most of the 12,720 pairs share a band and few are similar; each document but one meets one other by name.
    assert sum(pairs) < len(docs)
    sets = near_dedup.shingles([near_dedup.words_of(t) for t in docs])
    counts, documents = np.zeros(near_dedup.SKETCH), len(docs)
    for s, _ in sets:
        np.add.at(counts, s & np.uint32(near_dedup.SKETCH - 1), 1)
    idf = near_dedup.Idf(counts, documents)
    similar = [(a, b) for a in range(documents) for b in range(a) if near_dedup.weighted_jaccard(*sets[a], *sets[b], idf) >= 0.8]
    assert len(set(whole.values())) > 30 and sum(whole[a] != whole[b] for a, b in similar) == 0
    monkeypatch.setattr(near_dedup, "BLOCK", 9)
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()} == whole
    monkeypatch.setattr(near_dedup, "BLOCK", 4000)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 20_000)
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(df).collect()} == whole


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(2, 14), st.booleans())
def test_links_join_what_is_similar(r, n, crossed):
    base = words(r, r.choice((3, 20, 60)))
    sets = near_dedup.shingles([edited(r, base, r.choice((0, 1, 3, 8))) * r.choice((1, 1, 2)) or ["a"] for _ in range(n)])
    raw = []
    for s, count in sets:
        many = np.flatnonzero(count > 1).astype("<u4")
        raw.append(b"".join((np.uint32(len(s)).tobytes(), s.astype("<u4").tobytes(), many.tobytes(), count[many].astype("<u4").tobytes())))
    classes = [bytes([r.randrange(n)]) for _ in range(n)]
    idf = near_dedup.Idf(np.random.default_rng(r.randrange(100)).integers(0, 50, near_dedup.SKETCH), 50)
    left = np.arange(n // 2 if crossed else n)
    right = np.arange(n // 2, n) if crossed else left
    similar = {(x, y) for x in right.tolist() for y in left.tolist() if x != y and near_dedup.weighted_jaccard(*sets[x], *sets[y], idf) >= 0.8}

    def joined(links):
        own = list(classes)
        for x, y in links:
            own = [own[x] if c == own[y] else c for c in own]
        return [[a == b for a in own] for b in own]

    links = near_dedup.join_classes(raw, classes, left, right, idf, 0.8) if len(left) else []
    assert set(links) <= similar and len(links) < n and joined(links) == joined(similar)


def vectors_of(lists):
    sets, raw = near_dedup.shingles(lists), []
    for s, count in sets:
        many = np.flatnonzero(count > 1).astype("<u4")
        raw.append(b"".join((np.uint32(len(s)).tobytes(), s.astype("<u4").tobytes(), many.tobytes(), count[many].astype("<u4").tobytes())))
    return sets, raw


@pytest.mark.parametrize(("few", "columns", "cells"), [(2, 1024, 500_000), (2, 7, 40), (2, 150, 1), (1000, 1024, 500_000)])
def test_bounds_lose_no_link(monkeypatch, few, columns, cells):
    r = random.Random(12)
    for k, v in (("FEW", few), ("COLUMNS", columns), ("CELLS", cells), ("AT_ONCE", 3)):
        monkeypatch.setattr(near_dedup, k, v)
    idf = near_dedup.Idf(np.random.default_rng(2).integers(0, 50, near_dedup.SKETCH), 50)
    base = [words(r, 120), words(r, 25) * 6, words(r, 3)]
    sets, raw = vectors_of([edited(r, r.choice(base), r.choice((0, 1, 2, 3, 4, 6))) for _ in range(90)])
    similar = [(a, b) for a in range(90) for b in range(a) if near_dedup.weighted_jaccard(*sets[a], *sets[b], idf) >= 0.8]
    for left, right in ((range(90), range(90)), (range(40), range(40, 90))):
        own = list(range(90))
        for a, b in similar:
            if a in right and b in left:
                own = [own[a] if c == own[b] else c for c in own]
        got = list(range(90))
        for a, b in near_dedup.join_classes(raw, [bytes([k]) for k in range(90)], np.array(left), np.array(right), idf, 0.8):
            got = [got[a] if c == got[b] else c for c in got]
        assert 10 < len(set(own)) < 80 and [[a == b for a in own] for b in own] == [[a == b for a in got] for b in got]


def test_unlike_members_are_not_compared_shingle_by_shingle(monkeypatch):
    """A family of variants of one document, as it grows with the corpus: pairs that can't be similar cost a few numbers, not their vectors."""
    r = random.Random(13)
    base = words(r, 200)
    sets, raw = vectors_of([edited(r, base, 8) for _ in range(300)])
    idf = near_dedup.Idf(np.zeros(near_dedup.SKETCH), 1000)
    compared = []

    class Counting:
        def __getattr__(self, name):
            return getattr(np, name)

        def minimum(self, a, b):
            compared.append(np.minimum(a, b).size)
            return np.minimum(a, b)

    monkeypatch.setattr(near_dedup, "np", Counting())
    links = near_dedup.join_classes(raw, [k.to_bytes(2, "big") for k in range(300)], np.arange(300), np.arange(300), idf, 0.8)
    monkeypatch.undo()
    assert len(links) < 200 and sum(compared) < 10 * 300 * 300 < 0.1 * 300 * 300 * len(sets[0][0])


def test_groups_over_batches():
    rows = [(1, 1), (1, 1), (1, 2), (2, 2), (2, 2), (2, 2), (3, 0)]
    for cuts in ([], [2], [1, 4, 5], [0, 3, 3, 6]):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in p], pa.int64()), "b": pa.array([x[1] for x in p], pa.int32())}) for p in parts]
        assert [t.num_rows for t in near_dedup._groups(iter(batches), ("a", "b"))] == [2, 1, 3, 1]


def test_pipeline_stage_shuffles_no_unlike_pairs(spark, monkeypatch):
    import corpus_pipeline

    r = random.Random(9)
    base = words(r, 150)
    docs = [" ".join(edited(r, base, 7)) for _ in range(100)] + [" ".join(base)] * 2
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    verified, pairs = near_dedup._verified, []

    def counted(found, *others):
        found = near_dedup.cut(found)
        pairs.append(found.count())
        return verified(found, *others)

    monkeypatch.setattr(near_dedup, "_verified", counted)
    kept = {x.doc_id for x in corpus_pipeline.dedup_documents(spark, df, "").collect()}
    monkeypatch.undo()
    assert sum(pairs) < len(docs) and len(kept) > 30
    assert kept == {x.class_id for x in near_dedup.near_duplicates(df).collect()}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    key = lambda k: bytes([k])
    links = spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary")
    assert {x["node"][0]: x["class"][0] for x in near_dedup.components(links).collect()} == {k: find(k) for k in parent}
    half = near_dedup._merged(None, links.limit(30))
    assert {x["node"][0]: x["class"][0] for x in near_dedup._merged(half, links).collect()} == {k: find(k) for k in parent}


# -- lines ----------------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def sequences(*lists):
    return np.array([near_dedup.mix64(np.array([x], dtype=np.uint64))[0] for y in lists for x in y], dtype=np.uint64), np.cumsum([0, *map(len, lists)])


@settings(max_examples=300, deadline=None)
@given(st.integers(6, 30), st.integers(1, 6), st.lists(st.tuples(st.integers(0, 40), st.integers(0, 2), st.integers(0, 5)), max_size=3), st.randoms())
def test_anchors_and_links_lose_nothing(n, letters, edits, r):
    """Sequences within the bound share an anchor, and a link that the earlier leads and the later follows; links join no others."""
    a = [r.randrange(letters) for _ in range(n)]
    b = list(a)
    for at, how, x in edits:
        k = at % max(1, len(b))
        b[k : k + (how != 1)] = [] if how == 0 and len(b) > 1 else [x]
    near = distance(a, b)
    h, ends = sequences(a, b)
    none = np.zeros(2, dtype=np.int64)
    keys, row = line_dedup.anchors(h, ends, none)
    v, of, left, p, q = line_dedup.variants(h, ends, none)
    assert line_dedup.within(h[: ends[1]], h[ends[1] :], 2) == (near <= 2) and line_dedup.within(h[: ends[1]], h[ends[1] :], 1) == (near <= 1)
    if a == b or min(len(a), len(b)) < line_dedup.FEW:
        return
    if near <= 2:
        assert set(keys[row == 0].tolist()) & set(keys[row == 1].tolist())
    n_ = {x: len(set(of[(v == x) & (left < 2)].tolist())) for x in set(v.tolist())}
    t_ = {x: len(set(of[(v == x) & (left == 2)].tolist())) for x in set(v.tolist())}
    size = np.diff(ends)
    link, at, leads, follows = line_dedup.links(v, left, p, q, np.array([n_[x] for x in v.tolist()]), np.array([t_[x] for x in v.tolist()]), line_dedup.two(size[of]))
    for later in (0, 1):
        met = set(link[follows & (of[at] == later)].tolist()) & set(link[leads & (of[at] != later)].tolist())
        assert bool(met) == (near <= line_dedup.bound(int(size[later])))


def units_of(line):
    h, ends, _, _ = line_dedup.lines_of(pa.array([line]))
    u = line_dedup.Units(h, ends)
    return {int(k): u.h[a:b].tolist() for k, a, b in zip(u.level, u.ends, u.ends[1:])}


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    pool = [words(r, r.choice((3, 6, 7, 8, 9, 15, 20, 40, 47, 60, 150))) for _ in range(60)]
    pool += [edited(r, ws, r.choice((1, 1, 2, 2, 3))) for ws in pool for _ in range(2)]
    hot = words(r, 12)
    docs = {}
    for k in range(50):
        lines = [" ".join(r.choice(pool)) for _ in range(r.randint(0, 8))] + ([" ".join(hot)] if k % 3 == 0 else [])
        docs[k] = "\n".join(lines)
    docs |= {60: None, 61: "", 62: "\n\n", 63: docs[3], 64: " ".join(hot) + "  ", 65: " ".join([*hot[:5], *hot[6:]]), 66: " ".join(words(r, 30_000)), 67: "same " * 9000}
    rows = [(k, t, len(t or "")) for k, t in docs.items()]
    df = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, n_chars long").selectExpr("*", *(f"1 AS {n}" for n in ("line", "words", "__doc", "doc", "th", "exact", "near", "kept", "_kept")))
    seen, drop, two = [], {k: set() for k in docs}, 0
    for k in sorted(docs):
        for n, line in enumerate((docs[k] or "").split("\n")):
            ws = line.split()
            if not ws:
                continue
            own = units_of(line)
            apart = [distance(u, w[j]) for _, w in seen for j, u in own.items() if j in w and len(u) < 200 and abs(len(u) - len(w[j])) <= line_dedup.bound(len(u)) and distance(u, w[j]) <= line_dedup.bound(len(u))]
            if any(ws == w for w, _ in seen) or apart:
                drop[k].add(n)
                two += 0 not in apart and 1 not in apart and not any(ws == w for w, _ in seen)
            seen.append((ws, own))
    # A line also goes where its first occurrence has an earlier neighbour, which the loop above covers: the neighbour is earlier still.
    assert two > 3
    out = line_dedup.line_dedup(df)
    assert out.columns == df.columns
    got = out.collect()
    assert len(got) == len(docs) + 1
    for x in got:
        t = docs[x.doc_id]
        expected = None if t is None else "\n".join(line for n, line in enumerate(t.split("\n")) if n not in drop[x.doc_id])
        assert x.text == expected and x.n_chars == len(expected or "")
    report = {x.doc_id: x for x in line_dedup.line_report(df).collect()}
    assert all(report[k].n_exact + report[k].n_near == len(drop[k]) for k in docs) and sum(x.n_near for x in report.values()) > 3
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_short_and_unspaced_lines_are_compared_exactly(spark):
    line = "\u8fd9\u662f\u4e00\u4e2a\u6bb5\u843d" * 20
    df = spark.createDataFrame([(1, f"{line}\n\nhome page\nown one"), (2, f"own two\n{line}\n\nhome  page")], "doc_id long, text string")
    assert {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()} == {1: f"{line}\n\nhome page\nown one", 2: "own two\n"}
    assert {x.doc_id: x.n_exact for x in line_dedup.line_report(df).collect()} == {1: 0, 2: 2}


# -- decontamination ---------------------------------------------------------------------------------------------------------


def brute(index, text):
    ws = text.lower().split()
    h = decontaminate.word_hashes(ws)
    s, out = decontaminate.shingles(h), {}
    for k, item in enumerate(index.ids.tolist()):
        own = index.items[index.ends[k] : index.ends[k + 1]]
        n = min(max(1, index.sizes[k] - 4), len(s))
        best = max((index.jaccard(s[i : i + n], own) for i in range(len(s) - n + 1)), default=0)
        if best >= 0.8:
            out[item] = best
    return out


def test_windows_against_brute_force():
    r = random.Random(6)
    items = [(k, " ".join(words(r, r.randint(8, 60)))) for k in range(40)]
    index = decontaminate.Index.build(items)
    for k in range(150):
        ws = edited(r, items[k % 40][1].split(), r.randint(0, 2))
        text = " ".join([*words(r, r.randint(0, 50)), *ws, *words(r, r.randint(0, 50))])
        found = dict(decontaminate.search_texts([index], pa.array([text, None, ""]))[0])
        assert {a: round(b, 9) for a, b in found.items()} == {a: round(b, 9) for a, b in brute(index, text).items()}


def test_blocks_guarantee_the_radius(monkeypatch):
    r = random.Random(7)
    index = decontaminate.Index.build([(k, " ".join(words(r, 20 + k % 2))) for k in range(60)])
    probes = np.array([int(p) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 24))) for p in index.prints.tolist()], dtype=np.uint64)
    near = {(i, j) for i, p in enumerate(probes.tolist()) for j, q in enumerate(index.prints.tolist()) if (p ^ q).bit_count() <= index.radius and index.sizes[j] == 20}
    for pairs in (1 << 20, 7):  # however few pairs are held at once
        monkeypatch.setattr(decontaminate, "PAIRS", pairs)
        assert set(zip(*(x.tolist() for x in index.within_radius(probes, 20)))) == near


def test_the_index_prunes():
    """Of all items a window meets few: those of its size, and of these those near it in a block."""
    r = random.Random(17)
    index = decontaminate.Index.build([(k, " ".join(words(r, r.randint(20, 60)))) for k in range(800)])
    for text in (" ".join(words(r, 400)) for _ in range(5)):
        s = decontaminate.shingles(decontaminate.word_hashes(text.split()))
        for size in (20, 40, 60):
            index.within_radius(decontaminate.fingerprints(s, np.arange(len(s) - size), size - 4, index.frequencies), size)
    assert 0 < index.tried < 0.02 * index.windows * len(index.ids)


def test_parts_change_no_result(spark):
    """Weights are those of the whole benchmark, however many parts its index has."""
    r = random.Random(18)
    items = [(k, " ".join(edited(r, words(r, 60), 0))) for k in range(30)]
    items += [(100 + k, " ".join(edited(r, items[k][1].split(), 2))) for k in range(10)]
    docs = [(k, " ".join([*words(r, 20), *edited(r, items[k % 30][1].split(), 1), *words(r, 30_000 if k == 5 else 20)])) for k in range(60)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({x.doc_id: (list(x.item_ids), x.similarity) for x in decontaminate.contamination(df, bench, most_items=most).collect()} for most in (1000, 4))
    assert one == many and sum(len(x) > 0 for x, _ in one.values()) > 30


def test_contamination(spark):
    r = random.Random(8)
    items = [(k, " ".join(words(r, 25))) for k in range(6)] + [(7, None), (8, ""), (9, "two words"), (3, " ".join(words(r, 30)))]
    leak = items[2][1]
    docs = [(0, " ".join(words(r, 300))), (1, " ".join(words(r, 50)) + "\n" + leak.upper() + " " + " ".join(words(r, 50))), (2, None), (3, ""), (4, items[9][1]), (5, " ".join([*words(r, 5), "two", "words"])), (6, " ".join(leak.split()[:10]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS item_ids")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    for most in (1000, 2):
        got = {x.doc_id: x for x in decontaminate.contamination(df, bench, most_items=most).collect()}
        assert {k: list(x.item_ids) for k, x in got.items()} == {0: [], 1: [2], 2: [], 3: [], 4: [3], 5: [9], 6: []}
        assert [k for k, x in got.items() if x.contaminated] == [1, 4, 5] and got[1].similarity == 1
    kept = decontaminate.drop_contaminated(df, bench)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [0, 2, 3, 6]
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0


# -- pipeline and registry ------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    item = " ".join(words(r, 30))
    clean = [(k, "\n".join(" ".join(words(r, 20)) for _ in range(4)), "en") for k in range(30)]
    rows = [*clean, (40, clean[0][1], "en"), (41, " ".join(edited(r, clean[1][1].split(), 1)), "en"), (42, " ".join([*words(r, 60), item]), "en"), (43, "few words", "en"), (44, None, None)]
    spark.createDataFrame([(k, t, x, "s", len(t or "")) for k, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    out = corpus_pipeline.run(spark, str(tmp_path))
    ids = {x.doc_id for x in out.collect()}
    # The copied documents are the likeliest of so small a corpus, beyond its band.
    assert ids >= set(range(2, 30)) and not ids & {41, 42, 43, 44}
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_everything_else_stands_alone():
    code = "import sys; sys.modules['specframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, check=True).stdout) > 50


def test_registry():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


@pytest.mark.parametrize("module", [p.stem for p in (REPO / "specframe" / "llm").glob("*.py")])
def test_no_local_checkpoints(module):
    assert "localCheckpoint" not in (REPO / "specframe" / "llm" / f"{module}.py").read_text()
