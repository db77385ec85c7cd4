import math

import pytest
from test_sources import DOCUMENT

from specframe.run import Run, Spectrum


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("run") / "a.mzML"
    path.write_text(DOCUMENT, encoding="latin-1")
    return Run(spark, str(path))


def test_lookups(run):
    assert run.get_spectrum_count() == 5 and run.get_chromatogram_count() == 1 and run.info["run_id"] == "made-run" and run.format == "plain"
    s = run[2]
    assert s.peaks() == [(102, 10), (200, 40)] and s.precision == 20e-6 and s["MS:1000511"] == 2 and s["positive scan"] is True
    assert "MS:0" not in s and s.get("MS:0", 7) == 7
    assert run.get_spectrum("scan=3").mz == [103, 200]
    assert run["tic"] == run.get_chromatogram(0) == [(0.5, 3), (1.5, 4)]
    with pytest.raises(KeyError, match="between 1 and 3"):
        run[99]
    with pytest.raises(ValueError):
        run.get_chromatogram(1.5)
    assert [(s.mz[0], s["MS:1000511"]) for s in run] == [(101, 1), (102, 2), (103, 1)]
    c = run["TI"]  # no spectrum's id holds this text
    assert c.mz == c.time == [0.5, 1.5] and c.i == [3, 4] and c.profile == c.peaks() == [(0.5, 3), (1.5, 4)]
    assert c.with_times([1, 2]) == [(1, 3), (2, 4)] and c.with_intensities([7, 8]).i == [7, 8]
    with pytest.raises(ValueError):
        c.with_times([1])
    assert run.info["instrument"] == "a fine instrument" and run.element(2).startswith("<spectrum index=") and "443.71" in run.element(2)
    with pytest.raises(KeyError):
        run.element(99)


def test_spectrum(spark):
    a, b = Spectrum.of(spark, [(100, 200)]), Spectrum.of(spark, [(100, 200), (200, 300)])
    both = (a + b).peaks("centroided")
    assert [round(m) for m, _ in both] == [100, 200] and [round(i) for _, i in both] == [400, 300]
    assert max(abs(i) for i in (a - a).i) < 1e-9
    assert (b * 2).i == [400, 600] and (b / 2).i == [100, 150]
    assert b.reduce((150, 250)).peaks() == [(200, 300)] and b.highest_peaks(1) == [(200, 300)] and b.extreme_values("i") == (200, 300)
    assert a.has_peak(100.0001) == [(100, 200)] and a.has_peak(101) == [] and not a.has_overlapping_peak(100)
    assert math.isclose(a.similarity_to(b), 200 / math.hypot(200, 300)) and a.transform_mz(100) == 1_000_000
    assert a.estimated_noise_level("mean") == 200 and b.remove_noise("mean").peaks() == [(200, 300)]
    assert len(a.t_mz_set()) == 11 and a.transformed_peaks() == [(1_000_000, 200)]
    with pytest.warns(DeprecationWarning):
        assert b.highestPeaks(1) == b.highest_peaks(1)
    with pytest.raises(ValueError):
        a.of_kind("blurred")
