"""Streams over folders: scans as they arrive, and windowed sums of points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specframe.sources import mzml


def spectra(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Spectra of mzML files that appear in a folder; a file is read once."""
    text = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder)
    return mzml.spectra_from_xml(mzml.elements(text.select(F.col("value").alias("xml"))))


def windowed_intensity(points: DataFrame, time: str = "ts", value: str = "i", key: str = "id", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """key, start, n, total by tumbling windows; points later than the watermark are left out of a stream."""
    marked = points.withWatermark(time, late) if points.isStreaming else points
    return marked.groupBy(F.col(key), F.window(time, width)).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")
