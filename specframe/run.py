"""One run and its spectra as objects, over the DataFrame operators.

``Run`` opens a file lazily; ``Spectrum`` is a table of one spectrum's peaks
with the usual methods.  Each method gives a new object; nothing is changed in
place.  For work on many spectra use the operators on whole tables instead.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specframe.functions.numeric import PROTON, internal_precision, precision_of
from specframe.operators import deconvolute, match, similarity
from specframe.operators import peaks as pk
from specframe.operators import spectra as sp
from specframe.session import importable
from specframe.sources import mzml

KINDS = ("raw", "centroided", "reprofiled", "deconvoluted")
KEY = "spec_id"


class Spectrum:
    """Peaks (mz, i) of one spectrum, of one kind."""

    def __init__(self, peaks: DataFrame, precision: float = 5e-6, kind: str = "raw", is_profile: bool = False, row=None):
        if kind.lower() not in KINDS:
            raise ValueError(f"peaks are {', '.join(KINDS)}")
        self.table = peaks.select(F.lit(0).cast("long").alias(KEY), F.col("mz").cast("double").alias("mz"), F.col("i").cast("double").alias("i"))
        self.precision, self.kind, self.is_profile, self.row = precision, kind.lower(), is_profile, row

    @classmethod
    def of(cls, spark: SparkSession, peaks: list[tuple[float, float]], precision: float = 5e-6, kind: str = "raw", is_profile: bool = False) -> Spectrum:
        return cls(spark.createDataFrame([(float(m), float(i)) for m, i in peaks], "mz double, i double"), precision, kind, is_profile)

    def _new(self, table: DataFrame, kind: str | None = None) -> Spectrum:
        return Spectrum(table, self.precision, kind or self.kind, self.is_profile, self.row)

    @property
    def internal_precision(self) -> int:
        return internal_precision(self.precision)

    def of_kind(self, kind: str) -> Spectrum:
        """These peaks as another kind, made from those at hand."""
        kind = kind.lower()
        if kind not in KINDS:
            raise ValueError(f"peaks are {', '.join(KINDS)}")
        if kind == self.kind:
            return self
        if kind == "raw":
            raise ValueError("raw peaks can't be made from others")
        if kind == "centroided":
            return self._new(pk.centroided(self.table, self.is_profile or self.kind == "reprofiled"), kind)
        centroided = self if self.kind == "centroided" else self.of_kind("centroided")
        if kind == "reprofiled":
            return self._new(pk.reprofile(centroided.table, self.precision), kind)
        masses = deconvolute.deconvolute(centroided.table, self.precision)
        return self._new(masses.select(F.col("mass").alias("mz"), "i"), kind)

    def peaks(self, kind: str = "raw") -> list[tuple[float, float]]:
        """One spectrum's peaks on the driver, by m/z."""
        own = self if kind.lower() == self.kind or kind == "raw" else self.of_kind(kind)
        return [(r.mz, r.i) for r in own.table.orderBy("mz").collect()]

    @property
    def mz(self) -> list[float]:
        return [m for m, _ in self.peaks(self.kind)]

    @property
    def i(self) -> list[float]:
        return [i for _, i in self.peaks(self.kind)]

    def reduce(self, mz_range: tuple[float, float]) -> Spectrum:
        return self._new(pk.reduce_range(self.table, mz_range))

    def remove_noise(self, mode: str = "median", noise_level: float | None = None, signal_to_noise_threshold: float = 1.0) -> Spectrum:
        return self._new(pk.remove_noise(self.table, mode, noise_level, signal_to_noise_threshold, centroided=self.of_kind("centroided").table if self.kind == "raw" else None))

    def remove_precursor_peak(self) -> Spectrum:
        mzs = [p["mz"] for p in (self.row["precursors"] if self.row else []) if p["mz"] is not None]
        spark = self.table.sparkSession
        return self._new(match.remove_precursor_peaks(self.table, spark.createDataFrame([(0, m) for m in mzs], f"{KEY} long, target double"), self.precision))

    def estimated_noise_level(self, mode: str = "median") -> float:
        row = pk.noise_level_of(self.of_kind("centroided").table if self.kind == "raw" else self.table, mode).first()
        return row["noise"] if row else 0.0

    def highest_peaks(self, n: int) -> list[tuple[float, float]]:
        """Ascending by intensity."""
        rows = pk.highest_peaks(self.table, n).orderBy(F.desc("rank")).collect()
        return [(r.mz, r.i) for r in rows]

    def extreme_values(self, key: str) -> tuple[float, float] | tuple[()]:
        row = pk.extreme_values(self.table, key).first()
        return (row[1], row[2]) if row else ()

    def _targets(self, mz: float) -> DataFrame:
        return self.table.sparkSession.createDataFrame([(float(mz),)], "target double")

    def has_peak(self, mz: float) -> list[tuple[float, float]]:
        rows = match.match(self.of_kind("centroided").table if self.kind == "raw" else self.table, self._targets(mz), self.precision).orderBy("mz").collect()
        return [(r.mz, r.i) for r in rows]

    def has_overlapping_peak(self, mz: float) -> bool:
        row = match.has_overlapping_peak(self.table, self._targets(mz), self.precision).first()
        return bool(row and row["overlaps"])

    def transform_mz(self, mz: float) -> int:
        return round(mz * self.internal_precision)

    def transformed_peaks(self) -> list[tuple[int, float]]:
        return [(self.transform_mz(m), i) for m, i in self.peaks("centroided" if self.kind == "raw" else self.kind)]

    def t_mz_set(self) -> set[int]:
        return {r.bin for r in match.bin_set(self.of_kind("centroided").table if self.kind == "raw" else self.table, self.precision).collect()}

    def similarity_to(self, other: Spectrum, round_precision: int = 0) -> float:
        row = similarity.cosine(self.table, other.table, round_precision).first()
        return row["cosine"] if row else 0.0

    @staticmethod
    def ppm2abs(value: float, ppm: float, direction: int = 1, factor: float = 1) -> float:
        return value + value * ppm * factor * direction

    @staticmethod
    def neutral_mass(mz: float, charge: int) -> float:
        return (mz - PROTON) * charge

    def __mul__(self, x: float) -> Spectrum:
        return self._new(pk.scale(self.table, x))

    __rmul__ = __mul__

    def __truediv__(self, x: float) -> Spectrum:
        return self._new(pk.divide(self.table, x))

    def _combine(self, other: Spectrum, sign: int) -> Spectrum:
        a, b = (x.table if x.kind == "reprofiled" else pk.reprofile(x.of_kind("centroided").table, x.precision) for x in (self, other))
        grids = [t.select(F.round("mz", 9).alias("mz"), (F.col("i") * s).alias("i")) for t, s in ((a, 1), (b, sign))]
        return Spectrum(grids[0].unionByName(grids[1]).groupBy("mz").agg(F.sum("i").alias("i")), self.precision, "reprofiled", self.is_profile)

    def __add__(self, other: Spectrum) -> Spectrum:
        return self._combine(other, 1)

    def __sub__(self, other: Spectrum) -> Spectrum:
        return self._combine(other, -1)

    def __getitem__(self, accession: str):
        """True for a flag, a number or text, a list of several, None for none."""
        found = []
        for p in self.row["cv"] if self.row else []:
            if accession in (p["accession"], p["name"]):
                try:
                    found.append(True if p["value"] == "" else float(p["value"]))
                except ValueError:
                    found.append(p["value"])
        return found[0] if len(found) == 1 else found or None

    def get(self, accession: str, default=None):
        value = self[accession]
        return default if value is None else value

    def __contains__(self, accession: str) -> bool:
        return self[accession] is not None


def _alias(old: str, new: str) -> None:
    def call(self, *args, **kwargs):
        warnings.warn(f"{old} is now {new}", DeprecationWarning, stacklevel=2)
        return getattr(self, new)(*args, **kwargs)

    setattr(Spectrum, old, call)


for _old, _new in (("similarityTo", "similarity_to"), ("hasPeak", "has_peak"), ("extremeValues", "extreme_values"), ("transformMZ", "transform_mz"), ("hasOverlappingPeak", "has_overlapping_peak"), ("highestPeaks", "highest_peaks"), ("estimatedNoiseLevel", "estimated_noise_level"), ("removeNoise", "remove_noise")):
    _alias(_old, _new)


class Chromatogram(list):
    """Points (time, intensity) by time, as a list of pairs."""

    kind = "raw"

    @property
    def time(self) -> list[float]:
        return [t for t, _ in self]

    @property
    def mz(self) -> list[float]:
        """The times, under the name that spectra have for their first axis."""
        return self.time

    @property
    def i(self) -> list[float]:
        return [i for _, i in self]

    @property
    def profile(self) -> list[tuple[float, float]]:
        return list(self)

    def peaks(self) -> list[tuple[float, float]]:
        return list(self)

    def with_times(self, time: list[float]) -> Chromatogram:
        return Chromatogram(zip(map(float, time), self.i, strict=True))

    def with_intensities(self, i: list[float]) -> Chromatogram:
        return Chromatogram(zip(self.time, map(float, i), strict=True))


class Run:
    """A file: its header, tables of spectra and chromatograms, and look-ups."""

    def __init__(self, spark: SparkSession, path: str, precisions: dict[int, float] | None = None):
        self.spark, self.path, self.precisions = spark, path, precisions or {}
        self.format = mzml.file_format(path)
        self.spectra = mzml.spectra(spark, path, precisions=precisions)
        self.chromatograms = mzml.chromatograms(spark, path)

    @property
    def info(self) -> dict:
        """The header and its lists, from the head of the file."""
        return mzml.headers(self.spark, self.path).first().asDict(recursive=True)

    def get_spectrum_count(self) -> int | None:
        """As the header declares it; ``spectra.count()`` is what is there."""
        return self.info["spectrum_count"]

    def get_chromatogram_count(self) -> int | None:
        return mzml.runs(self.spark, self.path).first()["chromatogram_count"]

    def element(self, key: int) -> str:
        """The XML of a spectrum, as the file has it."""
        found = mzml.raw_elements(self.spark, self.path).where(sp.native_id(F.regexp_extract("element", r'\bid="([^"]*)"', 1)) == key).first()
        if found is None:
            raise KeyError(f"no spectrum {key}")
        return found["element"]

    def _spectrum(self, rows: DataFrame) -> Spectrum:
        row = rows.first()
        if row is None:
            low, high = sp.bounds(self.spectra).first()
            raise KeyError(f"no such spectrum; ids are between {low} and {high}")
        table = mzml.peaks(self.spectra.where(F.col("idx") == row["idx"]))
        return Spectrum(table, precision_of(row["ms_level"], self.precisions), is_profile=bool(row["is_profile"]), row=row.asDict(recursive=True))

    def get_spectrum(self, key: int | str) -> Spectrum:
        """By native id, or by text in the raw id."""
        return self._spectrum(sp.by_id(self.spectra, key) if isinstance(key, int) else sp.search_id(self.spectra, key))

    def get_chromatogram(self, key: int | str) -> Chromatogram:
        """(time, i) of a chromatogram by name or by ordinal."""
        if isinstance(key, bool) or not isinstance(key, (int, str)):
            raise ValueError("a chromatogram has a name or an ordinal")
        rows = sp.by_name(self.chromatograms, key) if isinstance(key, str) else sp.by_ordinal(self.chromatograms, key)
        points = mzml.chromatogram_points(rows).orderBy("pos").collect()
        if not points:
            raise KeyError(f"no chromatogram {key}")
        return Chromatogram((p.time, p.i) for p in points)

    def __getitem__(self, key: int | str) -> Spectrum | Chromatogram:
        """A spectrum by id or by text in its raw id; a chromatogram by name, or by text in it where no spectrum has that."""
        if isinstance(key, int):
            return self.get_spectrum(key)
        if not sp.by_name(self.chromatograms, key).isEmpty():
            return self.get_chromatogram(key)
        found = sp.search_any(self.spectra, self.chromatograms, key).first()
        return self.get_chromatogram(found["id"]) if found and found["kind"] == "chromatogram" else self.get_spectrum(key)

    def __iter__(self) -> Iterator[Spectrum]:
        """Spectra in file order, all from one pass over the file."""
        importable(self.spark)
        whole = self.spectra.withColumns({"mz": mzml.array_of(mzml.MZ), "i": mzml.array_of(mzml.INTENSITY)}).drop("arrays")
        for row in whole.orderBy("idx").toLocalIterator():
            own = row.asDict(recursive=True)
            peaks = list(zip(own.pop("mz") or [], own.pop("i") or []))
            table = self.spark.createDataFrame(peaks, "mz double, i double")
            yield Spectrum(table, precision_of(row["ms_level"], self.precisions), is_profile=bool(row["is_profile"]), row=own)
