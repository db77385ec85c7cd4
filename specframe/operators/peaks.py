"""Peak algebra over long tables (keys…, mz, i).

Every operator takes the columns that name a spectrum, so the same code serves
one run or many.  All but the points of ``reprofile`` is built-in functions:
nothing else leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from specframe.functions.numeric import internal_precision
from specframe.session import importable

KEYS = ("spec_id",)
NOISE_MODES = ("median", "mean", "mad")
#: Grid points that are made at once.
POINTS = 1 << 20


def distinct_mz(peaks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row for each m/z of a spectrum, its intensities added up."""
    return peaks.groupBy(*keys, "mz").agg(F.sum("i").alias("i"))


def explode_arrays(spectra: DataFrame, keys: Sequence[str] = KEYS, mz: str = "mz", i: str = "i") -> DataFrame:
    """Parallel arrays to rows (keys…, pos, mz, i)."""
    zipped = F.arrays_zip(F.col(mz).alias("mz"), F.col(i).alias("i"))
    return spectra.select(*keys, F.posexplode(zipped).alias("pos", "p")).select(*keys, "pos", F.col("p.mz").alias("mz"), F.col("p.i").alias("i"))


def collect_arrays(peaks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows back to parallel arrays, by ascending m/z; a spectrum's peaks are one row's worth."""
    both = F.array_sort(F.collect_list(F.struct("mz", "i")))
    return peaks.groupBy(*keys).agg(both.alias("p")).select(*keys, F.col("p.mz").alias("mz"), F.col("p.i").alias("i"))


# -- filters ---------------------------------------------------------------------------------------------------------


def reduce_range(peaks: DataFrame, mz_range: tuple[float, float]) -> DataFrame:
    """Peaks from the first to the second m/z, both included."""
    low, high = mz_range
    if low is None or high is None:
        raise ValueError("both ends of the range are needed")
    return peaks.where(F.col("mz").between(low, high))


def remove_noise(
    peaks: DataFrame, mode: str = "median", noise_level: float | None = None, signal_to_noise: float = 1.0, keys: Sequence[str] = KEYS, centroided: DataFrame | None = None
) -> DataFrame:
    """Peaks of at least so many times the noise, which comes from the centroided peaks or is given."""
    if noise_level is not None:
        return peaks.where(F.col("i") / noise_level >= signal_to_noise)
    noise = noise_level_of(peaks if centroided is None else centroided, mode, keys)
    kept = peaks.join(noise, list(keys)).where(F.try_divide("i", "noise") >= signal_to_noise)
    return kept.select(peaks.columns)


# -- aggregations ----------------------------------------------------------------------------------------------------


def total_intensity(peaks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return peaks.groupBy(*keys).agg(F.sum("i").alias("tic"))


def peak_count(peaks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return peaks.groupBy(*keys).agg(F.count("*").alias("n_peaks"))


def noise_level_of(peaks: DataFrame, mode: str = "median", keys: Sequence[str] = KEYS) -> DataFrame:
    """keys…, noise: the median, the mean, or the median absolute deviation from the median."""
    if mode not in NOISE_MODES:
        raise ValueError(f"mode must be one of {', '.join(NOISE_MODES)}")
    if mode == "mean":
        return peaks.groupBy(*keys).agg(F.avg("i").alias("noise"))
    middle = peaks.groupBy(*keys).agg(F.median("i").alias("noise"))
    if mode == "median":
        return middle
    away = peaks.join(middle.withColumnRenamed("noise", "middle"), list(keys)).withColumn("away", F.abs(F.col("i") - F.col("middle")))
    return away.groupBy(*keys).agg(F.median("away").alias("noise"))


def extreme_values(peaks: DataFrame, *columns: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Least and greatest m/z, intensity, or both in one pass."""
    if not columns or not {*columns} <= {"mz", "i"}:
        raise ValueError("extreme values are of mz or i")
    return peaks.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def highest_peaks(peaks: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """The n highest peaks of each spectrum, and their rank; the higher m/z first among equals.

    Spark keeps n rows a spectrum before the shuffle (a group limit under the window).
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("i"), F.desc("mz"))
    return peaks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


# -- profile and centroid ---------------------------------------------------------------------------------------------


def reprofile(peaks: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaussians on a grid: keys…, k (grid number), mz, i.

    Each peak spreads over the grid points within five of its widths, a width
    being twice the precision at its m/z; every fifth quarter bin is a point.
    Peaks are shuffled, not points: a spectrum's peaks come in order of their
    first point, and what no later peak reaches is complete.
    """
    grid = internal_precision(precision) / 4
    s = F.col("mz") * (2 * precision)
    low, high = F.bround((F.col("mz") - 5 * s) * grid).cast("long"), F.bround((F.col("mz") + 5 * s) * grid).cast("long")
    # The first multiple of five that isn't below the window; then only multiples are made.
    first = F.ceil(low / F.lit(5.0)) * 5
    own = peaks.select(*keys, "mz", "i", s.alias("s"), first.alias("first"), high.alias("high")).where("first <= high")
    at = F.col("k") / F.lit(grid)
    if keys:
        ordered = own.repartition(*keys).sortWithinPartitions(*keys, "first")
        schema = StructType([*(StructField(f.name, f.dataType) for f in own.schema.fields[: len(keys)]), StructField("k", LongType()), StructField("i", DoubleType())])
        importable(peaks.sparkSession)
        points = ordered.mapInArrow(partial(_points, n_keys=len(keys), grid=grid, most=POINTS), schema)
    else:
        spread = own.withColumn("k", F.explode(F.sequence("first", "high", F.lit(5).cast("long"))))
        height = F.col("i") * F.exp(-((F.col("mz") - at) * (F.col("mz") - at)) / (2 * F.col("s") * F.col("s")))
        points = spread.groupBy("k").agg(F.sum(height).alias("i"))
    return points.select(*keys, "k", at.alias("mz"), "i")


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal, and what isn't a number as well."""
    a, b = column[1:], column[:-1]
    if pa.types.is_nested(column.type):
        values = column.to_pylist()
        return np.array([x != y for x, y in zip(values[1:], values[:-1])], dtype=bool)
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    if pa.types.is_floating(column.type):
        other = pc.and_not(other, pc.and_(*(pc.fill_null(pc.is_nan(x), False) for x in (a, b))))
    return other.to_numpy(zero_copy_only=False)


def _points(batches: Iterator[pa.RecordBatch], n_keys: int, grid: float, most: int) -> Iterator[pa.RecordBatch]:
    """Points of peaks (keys…, mz, i, s, first, high), ordered by keys and first, some ``most`` of them at once."""
    last: pa.Table | None = None  # the keys of the last spectrum, and its points that later peaks may reach
    k0, i0, valid0 = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    for batch in batches:
        n_points = (batch.column("high").to_numpy() - batch.column("first").to_numpy()) // 5 + 1
        pieces = np.flatnonzero(np.diff(np.cumsum(n_points) // most, prepend=-1))
        for start, stop in zip(pieces, [*pieces[1:], batch.num_rows]):
            part = batch.slice(start, stop - start)
            names = part.schema.names[:n_keys]
            rows = pa.Table.from_batches([part]).select(names)
            # Row 0 stands for the spectrum before.
            rows = pa.concat_tables([rows.slice(0, 1) if last is None else last, rows]).combine_chunks()
            group = np.concatenate(([0], np.cumsum(np.any([_changes(c.combine_chunks()) for c in rows.columns], axis=0))))
            mz, s, first = (part.column(c).to_numpy(zero_copy_only=False) for c in ("mz", "s", "first"))
            there = part.column("i").is_valid().to_numpy(zero_copy_only=False)
            i = pc.fill_null(part.column("i"), 0).to_numpy(zero_copy_only=False)
            n = n_points[start:stop]
            row = np.repeat(np.arange(len(n)), n)
            k = first[row] + 5 * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
            away = mz[row] - k / grid
            with np.errstate(divide="ignore", invalid="ignore"):
                height = i[row] * np.exp(-(away * away) / (2 * s[row] * s[row]))
            row, k, height, valid = np.concatenate((np.zeros(len(k0), np.int64), row + 1)), np.concatenate((k0, k)), np.concatenate((i0, height)), np.concatenate((valid0, there[row]))
            least, span = int(k.min()), int(k.max()) - int(k.min()) + 1
            g = group[row]
            order = np.argsort(g * span + (k - least), kind="stable") if span < (1 << 62) // (g[-1] + 1) else np.lexsort((k, g))
            row, g, k = row[order], g[order], k[order]
            at = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1]))))
            row, g, k, height, valid = row[at], g[at], k[at], np.add.reduceat(height[order], at), np.add.reduceat(valid[order].astype(np.int64), at)
            done = (g < group[-1]) | (k < first[-1])
            last, k0, i0, valid0 = rows.slice(len(rows) - 1, 1), k[~done], height[~done], valid[~done]
            yield _told(rows.take(pa.array(row[done])), k[done], height[done], valid[done])
    if last is not None:
        yield _told(last.take(pa.array(np.zeros(len(k0), np.int64))), k0, i0, valid0)


def _told(keys: pa.Table, k: np.ndarray, i: np.ndarray, valid: np.ndarray) -> pa.RecordBatch:
    """Sums of nothing but nulls are null."""
    columns = [c.combine_chunks() for c in keys.columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(k), pa.array(i, mask=valid == 0)], names=[*keys.column_names, "k", "i"])


def centroid(profile: DataFrame, keys: Sequence[str] = KEYS, order: str = "mz") -> DataFrame:
    """Gaussian apexes of three-point maxima: keys…, mz, i.

    A maximum is a positive point above two positive neighbours, from a
    spectrum's third point to its last but one.  Where the gaps to the
    neighbours differ more than tenfold, or the logarithms leave nothing to
    divide by, there is no apex.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    seen = profile.select(
        *keys,
        F.lag("mz").over(w).alias("x1"), F.col("mz").alias("x2"), F.lead("mz").over(w).alias("x3"),
        F.lag("i").over(w).alias("y1"), F.col("i").alias("y2"), F.lead("i").over(w).alias("y3"),
        (F.row_number().over(w) - 1).alias("at"),
    )
    tops = seen.where("at >= 2 AND x3 IS NOT NULL AND y1 > 0 AND y3 > 0 AND y2 > y1 AND y2 > y3").where("x2 - x1 <= (x3 - x2) * 10 AND x3 - x2 <= (x2 - x1) * 10")
    even = tops.withColumn("y3", F.when(F.col("y3") == F.col("y1"), F.col("y3") + 0.01 * F.col("y1")).otherwise(F.col("y3")))
    x1, x2, x3, y1, y2, y3 = (F.col(c) for c in ("x1", "x2", "x3", "y1", "y2", "y3"))
    ratio = even.withColumn("r", F.try_divide(F.ln(y2 / y1), F.ln(y3 / y1)))
    r = F.col("r")
    apex = ratio.withColumn("mu", F.try_divide(r * (x1 * x1 - x3 * x3) - x1 * x1 + x2 * x2, 2 * (x2 - x1) - 2 * r * (x3 - x1)))
    mu = F.col("mu")
    wide = apex.withColumn("c2", F.try_divide(x2 * x2 - x1 * x1 - 2 * x2 * mu + 2 * x1 * mu, 2 * F.ln(y1 / y2)))
    height = y1 * F.exp(F.try_divide((x1 - mu) * (x1 - mu), 2 * F.col("c2")))
    return wide.select(*keys, mu.alias("mz"), height.alias("i")).where("mz IS NOT NULL AND i IS NOT NULL")


def centroided(raw: DataFrame, is_profile: bool, keys: Sequence[str] = KEYS) -> DataFrame:
    """Profile spectra get their apexes; centroid spectra are what they are."""
    return centroid(raw, keys) if is_profile else raw.select(*keys, "mz", "i")


# -- arithmetic --------------------------------------------------------------------------------------------------------


def scale(peaks: DataFrame, factor: float | Column) -> DataFrame:
    return peaks.withColumn("i", F.col("i") * factor)


def divide(peaks: DataFrame, by: float | Column) -> DataFrame:
    """Division by zero gives null."""
    return peaks.withColumn("i", F.try_divide(F.col("i"), by if isinstance(by, Column) else F.lit(by)))


def normalise(peaks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Intensities as shares of their spectrum's total."""
    return peaks.withColumn("i", F.try_divide(F.col("i"), F.sum("i").over(Window.partitionBy(*keys))))


def combine(left: DataFrame, right: DataFrame, precision: float, sign: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Sum (or, by a sign of -1, difference) of two sets of spectra on their common grid: keys…, k, mz, i.

    Spreading peaks over the grid is linear, so both sets are spread and added up at once.
    """
    columns = [*keys, "mz", "i"]
    return reprofile(left.select(columns).unionByName(right.withColumn("i", F.col("i") * sign).select(columns)), precision, keys)


def average(peaks: DataFrame, precision: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Normalised spectra added up on one grid: k, mz, i."""
    return reprofile(normalise(peaks, keys), precision, ()).select("k", "mz", "i")
