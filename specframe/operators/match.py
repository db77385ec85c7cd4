"""Matching of peaks with target m/z values by integer bins.

A peak occupies the bins within the precision of its m/z; a target matches if
its own bin is one of them.  Peaks lie in coarse buckets of m/z, a target is
listed in the one to three buckets where a peak may match it, so the join is an
equality on the bucket (and on further columns), with the interval tested within
it.  Peaks stay as they are; only targets, the short side, are listed more than
once.  Where the targets are known to be few, Spark broadcasts them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specframe.functions.numeric import bin_window, internal_precision, mz_bin, ppm_shift
from specframe.operators.peaks import KEYS

#: Buckets are as wide as the window of a peak at this m/z.
WIDEST = 1000.0


def with_window(peaks: DataFrame, precision: float) -> DataFrame:
    low, high = bin_window("mz", precision)
    return peaks.withColumn("low", low).withColumn("high", high)


def _bucketed(peaks: DataFrame, targets: DataFrame, precision: float, target: str) -> tuple[DataFrame, DataFrame]:
    """Peaks with their window and bucket, and targets with their bin in every bucket whose peaks may match."""
    bins = internal_precision(precision)
    width = 2 * WIDEST * precision * bins + 1
    low, high = bin_window("mz", precision)
    own = peaks.withColumns({"__low": low, "__high": high, "__bucket": F.floor(F.col("mz") * bins / width)})
    # A bin is at most one from the target, and the window's ends are rounded as well.
    first, last = ((F.col("__bin") - 1) / (1 + precision), (F.col("__bin") + 1) / (1 - precision))
    listed = F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))
    return own, targets.withColumn("__bin", mz_bin(target, precision)).withColumn("__bucket", listed)


def match(peaks: DataFrame, targets: DataFrame, precision: float, target: str = "target", on: Sequence[str] = ()) -> DataFrame:
    """Each peak beside each target that it matches; ``on`` names columns that must agree as well."""
    own, probe = _bucketed(peaks, targets, precision, target)
    inside = F.col("__bin").between(F.col("__low"), F.col("__high"))
    return own.join(probe, ["__bucket", *on]).where(inside).drop("__low", "__high", "__bin", "__bucket")


def has_peak(peaks: DataFrame, targets: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys…, target, n_peaks: how many peaks match, for those that any does."""
    return match(peaks, targets, precision).groupBy(*keys, "target").agg(F.count("*").alias("n_peaks"))


def has_overlapping_peak(peaks: DataFrame, targets: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys…, target, overlaps: whether more than one peak matches the target moved up by the precision."""
    moved = targets.withColumn("moved", ppm_shift("target", precision))
    found = match(peaks, moved, precision, "moved").groupBy(*keys, "target").agg(F.count("*").alias("n"))
    return found.select(*keys, "target", (F.col("n") > 1).alias("overlaps"))


def _new_bins(peaks: DataFrame, precision: float, keys: Sequence[str]) -> DataFrame:
    """Peaks by ascending window, and the first of their bins that no window before reaches (beyond ``high`` if there is none)."""
    w = Window.partitionBy(*keys).orderBy("low", "high")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return with_window(peaks, precision).select(*keys, "low", "high", F.greatest(F.col("low"), F.coalesce(before + 1, F.col("low"))).alias("new"))


def bin_set(peaks: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys…, bin: all bins that a spectrum's peaks occupy, each listed by the first window that has it, so that none is shuffled."""
    own = _new_bins(peaks, precision, keys).where("new <= high")
    return own.select(*keys, F.explode(F.sequence("new", "high")).alias("bin"))


def bin_set_size(peaks: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys…, n_bins: the size of the bin set, without listing the bins."""
    own = _new_bins(peaks, precision, keys)
    return own.groupBy(*keys).agg(F.sum(F.greatest(F.lit(0), F.col("high") - F.col("new") + 1)).alias("n_bins"))


def spectra_with(peaks: DataFrame, targets: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peaks that match any target, each once (a semi join)."""
    own, probe = _bucketed(peaks, targets.select("target"), precision, "target")
    both = (F.col("p.__bucket") == F.col("t.__bucket")) & F.col("t.__bin").between(F.col("p.__low"), F.col("p.__high"))
    return own.alias("p").join(probe.alias("t"), both, "left_semi").drop("__low", "__high", "__bucket")


def extracted_ion_chromatogram(scans: DataFrame, peaks: DataFrame, targets: DataFrame, precision: float, ms_level: int = 1, key: str = "spec_id") -> DataFrame:
    """key, scan_time, target, mz, i of the peaks that match, in scans of one level."""
    level = scans.where(F.col("ms_level") == ms_level).select(key, "scan_time")
    return match(peaks, targets, precision).join(level, key).select(key, "scan_time", "target", "mz", "i")


def remove_precursor_peaks(peaks: DataFrame, precursors: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Peaks without those that match a precursor of their own spectrum; precursors have keys… and target.

    A spectrum's few precursors come to its peaks as one array, so peaks meet them once.
    """
    bins = precursors.groupBy(*keys).agg(F.collect_set(mz_bin("target", precision)).alias("__bins"))
    low, high = bin_window("mz", precision)
    hit = F.coalesce(F.exists("__bins", lambda b: b.between(low, high)), F.lit(False))
    return peaks.join(bins, list(keys), "left").where(~hit).select(peaks.columns)


def annotate(peaks: DataFrame, ions: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """For each ion (ion, target) the first matching peak of each spectrum, by m/z."""
    first = F.min(F.struct("mz", "i")).alias("p")
    return match(peaks, ions, precision).groupBy(*keys, "ion", "target").agg(first).select(*keys, "ion", "target", "p.mz", "p.i")
