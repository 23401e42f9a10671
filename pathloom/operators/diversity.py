"""Exact duplicate and overlap detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def path_diversity(paths: DataFrame, keys: list[str], digits: int = 6) -> DataFrame:
    """Distinct complete paths, surplus copies and the largest multiplicity, by a hash of each path's values in order."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("period_index", F.round("r", digits).alias("r")))), lambda x: x["r"].cast("string"))
    hashed = paths.groupBy(*keys).agg(F.sha2(F.concat_ws(",", values), 256).alias("h"))
    counted = hashed.groupBy("h").agg(F.count("*").alias("m"))
    return counted.agg(F.count("*").alias("distinct_paths"), (F.sum("m") - F.count("*")).alias("duplicate_copies"), F.max("m").alias("largest"))


def repeated_windows(paths: DataFrame, column: str, width: int) -> DataFrame:
    o = Window.partitionBy("path_id").orderBy("period_index").rowsBetween(-(width - 1), 0)
    w = paths.withColumn("x", F.collect_list(column).over(o)).where(F.size("x") == width)
    g = w.groupBy("x").agg(F.count("*").alias("m"))
    return g.agg(F.sum("m").alias("windows"), F.count("*").alias("distinct_windows"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("m"))), F.lit(0)).alias("repeated"))


def overlapping_ranges(ranges: DataFrame, key: str, number: str, first: str, last: str) -> DataFrame:
    """Rows whose range meets the furthest end of the ranges before it: a window, not a self-join."""
    o = Window.partitionBy(key).orderBy(first, number).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("reach", F.max(last).over(o)).where(F.col(first) <= F.col("reach")).drop("reach")
