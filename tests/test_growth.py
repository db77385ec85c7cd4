"""What moves between tasks and to the driver, and the same results however the work is cut."""

import gzip
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from specframe.operators import peaks as pk
from specframe.operators import match, similarity
from specframe.sources import codec, igzip, mzml, sqlite


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(left, right, decimals):
    """Cosines of each two spectra that share a bin, as sums over rows."""

    def bins(rows):
        out = {}
        for s, mz, i in rows:
            own = out.setdefault(s, {})
            b = None if mz is None else round(mz, decimals)
            own[b] = own.get(b, 0.0) + (0.0 if i is None else i)
        return out

    a, b = bins(left), bins(right)
    norm = lambda x: math.sqrt(sum(i * i for i in x.values()))
    for p, x in a.items():
        for q, y in b.items():
            if p is not None and q is not None and (shared := x.keys() & y.keys() - {None}):
                n = norm(x) * norm(y)
                yield p, q, sum(x[k] * y[k] for k in shared) / n if n else 0.0


def near(found, expected):
    text = lambda c: "nan" if math.isnan(c) else f"{c + 0.0:.9f}"
    assert sorted((a, b, text(c)) for a, b, c in found) == sorted((a, b, text(c)) for a, b, c in expected)


@pytest.mark.parametrize("dense", [0, 3, 10**9])
@pytest.mark.parametrize("odd", [False, True])
def test_cosines_by_blocks(spark, monkeypatch, dense, odd):
    """Several blocks, bins as columns or as entries, nulls and what isn't finite: no pair is shuffled."""
    for name, value in (("BLOCK", 4), ("BINS", 7), ("PRODUCTS", 50), ("ROWS", 9), ("DENSE", dense)):
        monkeypatch.setattr(similarity, name, value)
    r = random.Random(3)
    rows = [(f"s{r.randrange(23)}", r.uniform(0, 40), float(r.randrange(-3, 9))) for _ in range(250)] + [("lone", 99.0, 0.0), ("other", 99.2, 5.0), ("far", 500.0, 0.0)]
    if odd:
        rows += [("s1", None, 7.0), ("s2", 3.0, None), ("inf", 4.0, math.inf), ("inf", 21.0, 2.0)]
    t = spark.createDataFrame(rows, "spec_id string, mz double, i double").repartition(5)
    expected = [x for d in (0, 1) for x in [[*brute(rows, rows, d)]]]
    for decimals in (0, 1):
        got = similarity.pairwise_cosine(t, decimals)
        assert "Exchange" not in plan(got) and "Join" not in plan(got)
        norms = {s: math.sqrt(sum(x * x for (q, _), x in _sums(rows, decimals).items() if q == s)) for s, _, _ in rows}
        near([tuple(x) for x in got.collect()], [(p, q, (1.0 if norms[p] > 0 else 0.0) if p == q else c) for p, q, c in expected[decimals]])
        left, right = t.where("spec_id < 's2'"), t.where("spec_id >= 's2'")
        between = [(p, q, c) for p, q, c in expected[decimals] if p < "s2" <= q]
        near([tuple(x) for x in similarity.cosine(left, right, decimals).collect()], between)


def _sums(rows, decimals):
    out = {}
    for s, mz, i in rows:
        k = s, None if mz is None else round(mz, decimals)
        out[k] = out.get(k, 0.0) + (i or 0.0)
    return out


@pytest.mark.parametrize("k", [1, 4, 40])
def test_nearest_vectors_by_blocks(spark, monkeypatch, k):
    """As all pairs ranked: ties, zeros, nulls, other lengths, what isn't a number; only k of a block and query leave the task."""
    monkeypatch.setattr(similarity, "VECTORS", 9)
    monkeypatch.setattr(similarity, "QUERIES", 4)
    r = random.Random(5)
    rows = [(n, [float(r.randrange(-2, 3)) for _ in range(3)]) for n in range(50)] + [(60, [1.0, 2.0]), (61, [0.0] * 3), (62, None), (63, [1.0, None, 2.0]), (64, []), (65, [math.nan, 1.0, 1.0]), (66, [math.inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 5 = 0 OR vec_id > 59")
    every = sorted((tuple(x) for x in similarity.array_cosine(v, q).collect()), key=lambda x: (x[1], not math.isnan(x[2]), -round(x[2], 6) if not math.isnan(x[2]) else 0, -1 if x[0] is None else x[0]))
    ranked = {}
    for a, b, c in every:
        ranked.setdefault(b, []).append((a, b, str(round(c, 6) + 0.0)))
    got = similarity.top_cosines(v, q, k)
    assert sorted(map(str, ((a, b, str(c)) for a, b, c in map(tuple, got.collect())))) == sorted(map(str, (x for own in ranked.values() for x in own[:k])))
    assert "Join" not in plan(got)


def test_long_indexed_gzip(spark, tmp_path):
    """Tasks write their own blocks of the one file; offsets beyond 99,999,999 have their place."""

    def noise(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [f"id-{k:09d}"], "block": [np.random.default_rng(k).bytes(1 << 21).decode("latin-1")]})

    path = str(tmp_path / "long.gz")
    n = igzip.write(spark.range(0, 56, 1, 4).mapInArrow(noise, "id string, block string"), path)
    index = igzip.read_index(path)
    assert n == 56 and list(index) == [f"id-{k:09d}" for k in range(56)] and max(index.values()) > 99_999_999
    assert all(igzip.read_block(path, index[f"id-{k:09d}"]) == np.random.default_rng(k).bytes(1 << 21) for k in (0, 1, 30, 55))
    assert [p.name for p in tmp_path.iterdir()] == ["long.gz"]
    small = spark.createDataFrame([(k, f"block {k}\n") for k in range(10)], "id long, block string").repartition(3)
    assert igzip.write(small, path, most=12) == 10
    whole = gzip.open(path, "rt").read()
    assert sorted(whole.split("\n")[:-1]) == sorted(f"block {k}" for k in range(10))
    assert sorted((r.id, r.text) for r in igzip.read_igzip(spark, path).collect()) == [(str(k), f"block {k}\n") for k in range(10)]
    with pytest.raises(ValueError, match="more than 9"):
        igzip.write(small, path, most=9)
    assert igzip.write(small.limit(0), path) == 0 and igzip.read_igzip(spark, path).count() == 0 and gzip.open(path).read() == b""


@pytest.mark.parametrize("kinds", [["MS:1000523", codec.ZLIB], [codec.PIC]])
def test_arrays_are_coded_one_by_one(kinds):
    """No number of a batch becomes a Python object that is kept, so memory is the arrays' own."""
    import tracemalloc

    v = pa.array([np.arange(1000.0) + k for k in range(300)] + [None, []], pa.list_(pa.float64()))
    tracemalloc.start()
    coded = codec.encode_all(v, kinds)
    back = codec.decode_all(coded, pa.array([kinds] * len(v)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert back.to_pylist() == [x or [] for x in v.to_pylist()] and coded[300].as_py() is None
    assert most < 3 * v.nbytes


def test_pic_of_all_kinds_of_integers():
    r = random.Random(2)
    for _ in range(300):
        xs = [float(r.choice([0, 15, 16, -1, -16, -17, 2**31 - 1, -(2**31), r.randrange(-(2**31), 2**31), r.randrange(300)])) for _ in range(r.randrange(9))]
        assert codec.encode_pic(xs) == codec._pack([h for x in xs for h in codec.encode_int(int(x + 0.5))])
    for bad in (2.0**31, math.nan, math.inf):
        with pytest.raises(ValueError):
            codec.encode_pic([bad])


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_grid_points_stay_in_their_task(spark, monkeypatch, most):
    """Dense and far peaks, nulls in keys and intensities, cut anywhere: the sums by grid number, and only peaks are shuffled."""
    monkeypatch.setattr(pk, "POINTS", most)
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, math.nan]), r.choice([r.uniform(50, 50.3), r.uniform(900, 901), 0.0]), r.choice([None, 1.0, r.uniform(0, 9)])) for _ in range(200)] + [("c", 1.0, None, 1.0), ("d", 1.0, 70.0, None)]
    t = spark.createDataFrame(rows, "run string, scan double, mz double, i double").repartition(3)
    expected = {}
    for run, scan, mz, i in rows:
        if mz is not None:
            s = mz * 4e-5
            for k in range(math.floor((mz - 5 * s) * 625) - 1, math.ceil((mz + 5 * s) * 625) + 1):
                if k % 5 == 0 and round((mz - 5 * s) * 625) <= k <= round((mz + 5 * s) * 625):
                    own = expected.setdefault((run, str(scan), k), [])
                    own += [] if i is None else [i * math.exp(-((mz - k / 625) ** 2) / (2 * s * s)) if s else math.nan]
    got = pk.reprofile(t, 20e-6, ("run", "scan"))
    text = plan(got)
    found = {(x.run, str(x.scan), x.k): x.i for x in got.collect()}
    assert got.count() == len(found) and found.keys() == expected.keys()
    for key, i in found.items():
        assert i is None if not expected[key] else math.isnan(i) if math.isnan(sum(expected[key])) else math.isclose(i, sum(expected[key]), rel_tol=1e-12)
    assert text.count("Exchange hashpartitioning") == 1 and text.index("MapInArrow") < text.index("Exchange hashpartitioning") and "Aggregate" not in text


def test_bins_stay_in_their_task(spark):
    """Overlapping, equal and nested windows, and a null: each bin once, and peaks are all that is shuffled."""
    r = random.Random(6)
    rows = [(k % 3, r.choice([r.uniform(99, 99.02), r.uniform(5, 900), 50.0])) for k in range(300)] + [(5, None), (None, 50.0)]
    t = spark.createDataFrame(rows, "spec_id long, mz double").repartition(3)
    expected = sorted({(s, b) for s, m in rows if m is not None for b in range(round((m - m * 20e-6) * 2500), round((m + m * 20e-6) * 2500) + 1)}, key=str)
    got = match.bin_set(t, 20e-6)
    text = plan(got)
    assert "Aggregate" not in text and text.count("Exchange hashpartitioning") == 1
    assert sorted(((x.spec_id, x.bin) for x in got.collect()), key=str) == expected


def test_ladders_begin_only_where_a_peak_is_near(monkeypatch):
    """As step by step for each peak and charge, with far fewer look-ups."""
    import types

    from specframe.operators import deconvolute

    calls = []
    real = np.searchsorted
    counting = types.SimpleNamespace(**{x: getattr(np, x) for x in dir(np) if not x.startswith("_")})
    counting.searchsorted = lambda *a, **k: calls.append(1) or real(*a, **k)
    monkeypatch.setattr(deconvolute, "np", counting)
    r = np.random.default_rng(3)
    for n, span in ((600, 1000), (60, 4), (0, 1), (1, 1)):
        mz = np.concatenate((r.uniform(50, 50 + span, n), *(m + np.arange(4) * deconvolute.PROTON / z for m, z in zip(r.uniform(50, 50 + span, n // 20), r.integers(1, 9, n // 20)))))
        i = r.uniform(1, 9, len(mz)).round(1)
        calls.clear()
        got = deconvolute.ladders(mz, i, 20e-6)
        assert len(calls) <= 2 + 8 * len(mz) / (4 if span > 4 else 1)
        assert got == _ladders(mz, i, 20e-6)


def _ladders(mz, i, precision, most=8, proton=1.00727646677):
    order = np.argsort(mz, kind="stable")
    mz, i = mz[order], i[order]
    used, out = set(), []
    for k in range(len(mz)):
        best, charge = [], 0
        for z in range(1, most + 1) if k not in used else ():
            chain = [k]
            while True:
                want = mz[k] + len(chain) * proton / z
                near = [j for j in np.flatnonzero((mz >= want - want * precision) & (mz < want + want * precision)).tolist() if j not in used and i[j] <= i[chain[-1]] and j not in chain]
                if not near:
                    break
                chain.append(min(near, key=lambda j: abs(mz[j] - want)))
            if len(chain) > max(1, len(best)):
                best, charge = chain, z
        if best:
            used.update(best)
            out.append(((mz[k] - proton) * charge, float(i[best].sum()), charge))
    return out


@pytest.mark.parametrize("suffix", ["mzML", "mzML.gz"])
@pytest.mark.parametrize("n_files", [1, 3])
def test_few_files_of_many_tasks(spark, tmp_path, suffix, n_files):
    """So many whole files with all elements, though no task reads all of them."""
    spark.sparkContext.setJobGroup("few files", "")
    df = spark.createDataFrame([(k, [100.0 + k], [1.0]) for k in range(40)], "n long, mz array<double>, i array<double>").repartition(4)
    folder = mzml.write(mzml.spectrum_elements(df, "n", ["MS:1000523"]), str(tmp_path), suffix, files=n_files, run="r")
    stages = [s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("few files") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    tasks = [i.numTasks for s in stages if (i := spark.sparkContext.statusTracker().getStageInfo(s))]
    spark.sparkContext._jsc.clearJobGroup()
    assert sum(n >= 4 for n in tasks) >= 3  # shuffled, written, and put into place by four tasks
    assert sorted(p.name for p in tmp_path.iterdir()) == [f"part-{k:05d}.{suffix}" for k in range(n_files)]
    assert mzml.spectra(spark, folder).select("native_id").orderBy("native_id").collect() == [(k,) for k in range(40)]
    heads = mzml.headers(spark, folder).collect()
    assert len(heads) == n_files and sum(h.spectrum_count for h in heads) == 40 and max(h.spectrum_count for h in heads) < 40 / n_files + 4
    text = gzip.open if suffix.endswith("gz") else open
    assert all(text(p, "rb").read().endswith(b"</spectrum>\n</spectrumList></run></mzML>\n") for p in tmp_path.iterdir())
    (tmp_path / "none").mkdir()
    mzml.write(spark.createDataFrame([], "element string"), str(tmp_path / "none"), suffix, files=1)
    assert mzml.headers(spark, str(tmp_path / "none")).first().spectrum_count == 0


def test_sqlite_is_filled_by_tasks(spark, tmp_path, monkeypatch):
    """No row comes to the driver, and an id that comes twice is an error."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    path = str(tmp_path / "store.db")
    df = spark.createDataFrame([(k * 7 % 50, f"<spectrum n='{k}'/>") for k in range(50)], "id long, element string").repartition(4)
    assert sqlite.write(df, path) == 50
    assert sorted(tuple(r) for r in sqlite.read(spark, path).collect()) == sorted((k * 7 % 50, f"<spectrum n='{k}'/>") for k in range(50))
    assert [p.name for p in tmp_path.iterdir()] == ["store.db"]
    with pytest.raises(Exception, match="UNIQUE"):
        sqlite.write(df.unionByName(df), str(tmp_path / "twice.db"))
