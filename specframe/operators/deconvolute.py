"""Charge deconvolution of centroided peaks, spectrum by spectrum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from specframe.functions.numeric import PROTON
from specframe.session import importable


def ladders(mz: np.ndarray, i: np.ndarray, precision: float, most: int = 8) -> list[tuple[float, float, int]]:
    """(neutral mass, intensity, charge) of greedy ladders: spacing PROTON / charge, intensities falling.

    Peaks are taken from the lowest m/z on; of all charges the one with the
    longest ladder counts, the lower one among equals.  Lone peaks are left out.
    All second steps are looked up at once; where nothing is near, no ladder begins.
    """
    order = np.argsort(mz, kind="stable")
    mz, i = mz[order], i[order]
    used = np.zeros(len(mz), dtype=bool)
    out = []
    second = mz[:, None] + PROTON / np.arange(1, most + 1)
    begins = np.searchsorted(mz, second - second * precision) < np.searchsorted(mz, second + second * precision)
    for k in np.flatnonzero(begins.any(axis=1)):
        if used[k]:
            continue
        best: list[int] = []
        charge = 0
        for z in (np.flatnonzero(begins[k]) + 1).tolist():
            chain = [int(k)]
            while True:
                want = mz[k] + len(chain) * PROTON / z
                a, b = np.searchsorted(mz, [want - want * precision, want + want * precision])
                near = [j for j in range(a, b) if not used[j] and i[j] <= i[chain[-1]] and j not in chain]
                if not near:
                    break
                chain.append(min(near, key=lambda j: abs(mz[j] - want)))
            if len(chain) > max(1, len(best)):
                best, charge = chain, z
        if best:
            used[best] = True
            out.append(((mz[k] - PROTON) * charge, float(i[best].sum()), charge))
    return out


def deconvolute(peaks: DataFrame, precision: float, key: str = "spec_id", most: int = 8) -> DataFrame:
    """key, mass, i, charge; a group is one spectrum."""
    kind = peaks.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        found = ladders(t.column("mz").to_numpy(), t.column("i").to_numpy(), precision, most)
        columns = list(zip(*found)) or [[], [], []]
        return pa.table({key: pa.array([t.column(key)[0].as_py()] * len(found), t.schema.field(key).type), "mass": pa.array(columns[0], pa.float64()), "i": pa.array(columns[1], pa.float64()), "charge": pa.array(columns[2], pa.int32())})

    importable(peaks.sparkSession)
    return peaks.select(key, "mz", "i").groupBy(key).applyInArrow(run, f"{key} {kind}, mass double, i double, charge int")
