"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path
from statistics import median

from specframe.plans import catalog
from specframe.session import local_session

HEADLINE = (
    "xic", "has_peak", "has_peak_many", "overlapping_peak", "t_mz_set_size", "remove_precursor_peak", "fragment_annotation", "tic_by_scan", "noise_median", "noise_mad",
    "remove_noise_median", "reduce_mz_range", "highest_peaks", "extreme_values", "average_spectra", "spectrum_add", "reprofile_grid", "centroid_gauss", "precursor_top10", "precursor_parent",
    "native_id_parse", "embedding_cosine_topk", "chrom_tic", "stick_trace", "triangle_trace", "zlib_roundtrip", "mzml_scan",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory=os.environ.get("BENCH_MEMORY", "8g"))
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        seconds[name] = round(median(runs), 3)
    print(json.dumps({"metric": "sum of median seconds of three warm-session runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
