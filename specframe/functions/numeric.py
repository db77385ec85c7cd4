"""Column expressions for m/z arithmetic.

Rounding is half to even throughout, as the binning contract asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROTON = 1.00727646677
#: Relative precision by MS level; 0 is for spectra of no level.
PRECISIONS = {0: 1e-4, 1: 5e-6, 2: 20e-6, 3: 20e-6}


def col(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def internal_precision(precision: float) -> int:
    """Bins per unit of m/z for a relative precision."""
    if precision <= 0:
        raise ValueError("precision must be positive")
    bins = round(50_000 / (precision * 1e6))
    if bins < 1:
        raise ValueError(f"a precision of {precision} puts every peak into one bin")
    return bins


def precision_of(ms_level: int | None, overrides: dict[int, float] | None = None) -> float:
    known = PRECISIONS | (overrides or {})
    level = ms_level or 0
    if level not in known:
        raise KeyError(f"no precision is known for MS level {level}")
    return known[level]


def mz_bin(mz: Column | str | float, precision: float) -> Column:
    """The bin of an m/z value."""
    return F.bround(col(mz) * internal_precision(precision)).cast("long")


def bin_window(mz: Column | str | float, precision: float) -> tuple[Column, Column]:
    """First and last bin within the precision of a measured m/z value."""
    v, bins = col(mz), internal_precision(precision)
    return F.bround((v - v * precision) * bins).cast("long"), F.bround((v + v * precision) * bins).cast("long")


def ppm_shift(value: Column | str | float, ppm: float, direction: int = 1, factor: float = 1) -> Column:
    """A value moved by so many relative parts."""
    v = col(value)
    return v + v * (ppm * factor * direction)


def neutral_mass(mz: Column | str, charge: Column | str | int) -> Column:
    return (col(mz) - PROTON) * col(charge)
