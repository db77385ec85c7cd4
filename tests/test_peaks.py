import math

import pytest
from pyspark.sql import functions as F

from specframe.functions import numeric
from specframe.operators import deconvolute, match, similarity
from specframe.operators import peaks as pk

P = 5e-6


def table(spark, rows):
    return spark.createDataFrame([(s, float(m), float(i)) for s, m, i in rows], "spec_id long, mz double, i double")


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_precision():
    assert numeric.internal_precision(5e-6) == 10_000
    assert numeric.internal_precision(20e-6) == 2500
    with pytest.raises(ValueError):
        numeric.internal_precision(61)
    assert numeric.precision_of(None) == 1e-4
    with pytest.raises(KeyError):
        numeric.precision_of(9)


def test_reduce_and_extremes(spark):
    t = table(spark, [(1, 50, 100), (1, 102, 300), (1, 400, 20), (1, 401, 207)])
    assert rows(pk.reduce_range(t, (100, 400)), "mz", "i") == [(102, 300), (400, 20)]
    with pytest.raises(ValueError):
        pk.reduce_range(t, (None, None))
    u = table(spark, [(1, 1, 10000), (1, 10000, 1), (1, 500, 600)])
    assert rows(pk.extreme_values(u, "mz"), "min_mz", "max_mz") == [(1, 10000)]
    assert rows(pk.extreme_values(u, "i"), "min_i", "max_i") == [(1, 10000)]
    with pytest.raises(ValueError):
        pk.extreme_values(u, "x")


def test_noise(spark):
    t = table(spark, [(1, k, i) for k, i in enumerate((1, 2, 3, 4, 100))] + [(2, 1, 5)])
    assert rows(pk.noise_level_of(t, "median"), "spec_id", "noise") == [(1, 3), (2, 5)]
    assert rows(pk.noise_level_of(t, "mean"), "spec_id", "noise") == [(1, 22), (2, 5)]
    assert rows(pk.noise_level_of(t, "mad"), "spec_id", "noise") == [(1, 1), (2, 0)]
    with pytest.raises(ValueError):
        pk.noise_level_of(t, "sum")
    assert rows(pk.remove_noise(t, "median", signal_to_noise=1.2), "spec_id", "i") == [(1, 4), (1, 100)]
    assert rows(pk.remove_noise(t, noise_level=2.0, signal_to_noise=2.0), "i") == [(4,), (5,), (100,)]
    # Zero noise: nothing can be divided by it.
    assert rows(pk.remove_noise(t.where("spec_id = 2"), "mad"), "i") == []


def test_highest_peaks(spark):
    t = table(spark, [(1, 1, 5), (1, 2, 5), (1, 3, 1), (2, 1, 1)])
    assert rows(pk.highest_peaks(t, 2), "spec_id", "rank", "mz") == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_reprofile_then_centroid(spark):
    one = pk.centroid(pk.reprofile(table(spark, [(1, 100, 200)]), P)).collect()
    assert len(one) == 1 and math.isclose(one[0].mz, 100, rel_tol=5e-6) and abs(one[0].i - 200) < 2e-3


def test_sum_difference_average(spark):
    a, b = table(spark, [(1, 100, 200)]), table(spark, [(1, 100, 200), (1, 200, 300)])
    got = rows(pk.centroid(pk.combine(a, b, P, keys=("spec_id",))), "mz", "i")
    assert [round(m) for m, _ in got] == [100, 200] and [round(i) for _, i in got] == [400, 300]
    assert pk.combine(a, a, P, -1).agg(F.max(F.abs("i"))).first()[0] < 1e-9
    both = a.unionByName(b.withColumn("spec_id", F.lit(2).cast("long")))
    mean = rows(pk.centroid(pk.average(both, P).withColumn("spec_id", F.lit(1))), "i")
    assert all(abs(x - y) < 1e-4 for (x,), y in zip(mean, (0.6, 1.4)))


def test_centroid_skips(spark):
    profile = [(1, 99.999, 0.1), (1, 99.9995, 1), (1, 100, 10), (1, 100.0005, 1), (1, 100.001, 0.1)]
    assert abs(pk.centroid(table(spark, profile)).first().mz - 100) < 1e-3
    # A maximum at the second point, uneven gaps, and a zero beside it have no apex.
    assert pk.centroid(table(spark, profile[1:])).count() == 0
    assert pk.centroid(table(spark, [*profile[:3], (1, 101, 1), (1, 102, 0.1)])).count() == 0
    assert pk.centroid(table(spark, [*profile[:3], (1, 100.0005, 0), (1, 100.001, 0.1)])).count() == 0
    assert rows(pk.centroided(table(spark, profile), False), "mz")[0] == (99.999,)


def test_scaling(spark):
    t = table(spark, [(1, 1, 4), (1, 2, 6)])
    assert rows(pk.scale(t, 2), "i") == [(8,), (12,)]
    assert rows(pk.divide(t, 2), "i") == [(2,), (3,)]
    assert rows(pk.divide(t, 0), "mz") == [(1,), (2,)] and pk.divide(t, 0).where("i is not null").count() == 0
    assert rows(pk.normalise(t), "i") == [(0.4,), (0.6,)]


def bins(mz, p=P, ip=10_000):
    return range(round((mz - mz * p) * ip), round((mz + mz * p) * ip) + 1)


def test_matching_plans_agree(spark):
    peaks = [(k % 3, 100 + k * 0.0007, k + 1) for k in range(200)]
    targets = [100.0, 100.0042, 100.07, 100.1391, 500.0]
    expected = sorted((s, t) for s, m, _ in peaks for t in targets if round(t * 10_000) in bins(m))
    t, probe = table(spark, peaks), spark.createDataFrame([(x,) for x in targets], "target double")
    assert rows(match.match(t, probe, P), "spec_id", "target") == expected
    own = probe.crossJoin(spark.createDataFrame([(0,), (2,)], "spec_id long"))
    assert rows(match.match(t, own, P, on=["spec_id"]), "spec_id", "target") == [x for x in expected if x[0] != 1]
    counts = {(s, x): sum(e == (s, x) for e in expected) for s, x in expected}
    assert rows(match.has_peak(t, probe, P), "spec_id", "target", "n_peaks") == sorted((*k, n) for k, n in counts.items())
    sizes = {s: len({b for q, m, _ in peaks if q == s for b in bins(m)}) for s in range(3)}
    assert dict(rows(match.bin_set_size(t, P), "spec_id", "n_bins")) == sizes
    assert match.bin_set(t, P).count() == sum(sizes.values())
    assert {r.mz for r in match.spectra_with(t, probe, P).collect()} == {m for _, m, _ in peaks if any(round(x * 10_000) in bins(m) for x in targets)}


def test_matching_at_all_scales(spark):
    """Buckets lose nothing, from small to large m/z and from fine to coarse precision."""
    import random

    r = random.Random(4)
    for p in (5e-6, 20e-6, 1e-3):
        ip = round(50_000 / (p * 1e6))
        targets = [round(10 ** r.uniform(-0.5, 4.5), 4) for _ in range(150)]
        peaks = [(1, t * (1 + r.uniform(-2, 2) * p) + r.uniform(-2, 2) / ip, k + 1) for k, t in enumerate(targets) for _ in range(3)]
        found = rows(match.match(table(spark, peaks), spark.createDataFrame([(x,) for x in targets], "target double"), p), "mz", "target")
        assert found == sorted((m, t) for _, m, _ in peaks for t in targets if round(t * ip) in bins(m, p, ip))


def test_precursor_removal_and_annotation(spark):
    t = table(spark, [(1, 443.71124268, 9), (1, 500, 1), (2, 443.71124268, 9), (2, 443.711243, 5)])
    pre = spark.createDataFrame([(1, 443.711242675781)], "spec_id long, target double")
    assert rows(match.remove_precursor_peaks(t, pre, P), "spec_id", "mz") == [(1, 500), (2, 443.71124268), (2, 443.711243)]
    ions = spark.createDataFrame([("b1", 443.7112), ("y1", 600.0)], "ion string, target double")
    assert rows(match.annotate(t, ions, P), "spec_id", "ion", "i") == [(1, "b1", 9), (2, "b1", 9)]
    over = match.has_overlapping_peak(t, spark.createDataFrame([(443.711242,)], "target double"), P)
    assert rows(over, "spec_id", "overlaps") == [(1, False), (2, True)]


def test_cosine(spark):
    t = table(spark, [(1, 10.2, 3), (1, 20, 4), (2, 10.4, 3), (2, 20.1, 4), (3, 10, 1), (4, 99, 0)])
    got = {(a, b): c for a, b, c in rows(similarity.cosine(t, t), "left_id", "right_id", "cosine")}
    assert math.isclose(got[1, 2], 1) and math.isclose(got[1, 3], 0.6) and got[4, 4] == 0


def test_pairwise_cosine_is_the_general_one(spark):
    t = table(spark, [(1, 10.2, 3), (1, 20, 4), (2, 10.4, 3), (2, 20.1, 4), (3, 10, 1), (4, 99, 0)])
    got, expected = ({(a, b): round(c, 9) for a, b, c in rows(x, "left_id", "right_id", "cosine")} for x in (similarity.pairwise_cosine(t), similarity.cosine(t, t)))
    assert got == expected


def test_vectors_in_blocks(spark):
    v = spark.createDataFrame([(k, [float(k % 3), 1.0, float(k)]) for k in range(30)] + [(99, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    one, many = (sorted((a, b, round(c, 9)) for a, b, c in rows(similarity.array_cosine(v, v.where("vec_id % 3 = 0"), most=n), "vec_id", "query", "cosine")) for n in (100, 3))
    assert one == many and len(one) == 31 * 11


def test_deconvolution(spark):
    t = table(spark, [(1, 430.313, 100), (1, 430.313 + numeric.PROTON / 3, 49), (2, 500, 1)])
    got = deconvolute.deconvolute(t, P).collect()
    assert len(got) == 1 and got[0].charge == 3 and got[0].i == 149 and math.isclose(got[0].mass, 3 * 430.313 - 3 * numeric.PROTON)


def test_empty(spark):
    none = table(spark, []).limit(0)
    for df in (pk.noise_level_of(none, "mad"), pk.centroid(none), pk.reprofile(none, P), match.bin_set_size(none, P), pk.highest_peaks(none, 1)):
        assert df.count() == 0
