"""Series in order: second differences, and back by two running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def second_differences(rows: DataFrame, value: str, order: str, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """rows with the differences of the differences of a value, the first two against zero."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = rows.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))
    return first.withColumn(value, F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def running_sums(rows: DataFrame, value: str, order: str, keys: Sequence[str] = ("spec_id",)) -> DataFrame:
    """The reverse of ``second_differences``."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn(value, F.sum(value).over(w)).withColumn(value, F.sum(value).over(w))
