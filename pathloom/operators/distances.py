"""Distances between return samples, and gaps of tails, shapes and serial dependence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def wasserstein(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Mean gap of equally many sorted values; samples of unequal size are paired up to the smaller one's ranks."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("x"))
    x, y = a.withColumn("k", rank), b.withColumn("k", rank).withColumnRenamed("x", "y")
    return x.join(y, [by, "k"]).groupBy(by).agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("distance"))


def joint_samples(a: DataFrame, b: DataFrame, columns: list[str], place: str = "period_index", most: int = 256) -> tuple[DataFrame, DataFrame]:
    """Both samples, centred and scaled by the reference b, and as many evenly spaced rows of each: the smaller size, ``most``
    at most (the feature's own bound). place numbers a sample's rows from 1."""
    known = [F.avg(c).alias(f"m_{c}") for c in columns] + [F.stddev_samp(c).alias(f"s_{c}") for c in columns]
    stats = F.broadcast(b.agg(*known, F.count("*").alias("n_b")).crossJoin(a.agg(F.count("*").alias("n_a"))))  # one row

    def picked(df: DataFrame, n: str) -> DataFrame:
        size, i = F.least(F.lit(most), "n_a", "n_b"), F.col(place) - 1
        step = (F.col(n) - 1) / (size - 1)
        k = F.ceil(i / step)
        even = (size == F.col(n)) | (i == F.col(n) - 1) | (k < size - 1) & (F.floor(k * step) == i)
        return df.crossJoin(stats).where(even).select(*[((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(c) for c in columns])

    return picked(a, "n_a"), picked(b, "n_b")


def sliced_wasserstein(a: DataFrame, b: DataFrame, columns: list[str], directions: list[list[float]]) -> DataFrame:
    """Mean over directions of the distance of projections of joint samples. directions is a short, fixed list."""
    def projected(df: DataFrame) -> DataFrame:
        each = [F.struct(F.lit(i).alias("direction"), sum((F.col(c) * v for c, v in zip(columns, d, strict=True)), F.lit(0.0)).alias("x")) for i, d in enumerate(directions)]
        return df.select(F.explode(F.array(*each)).alias("e")).select("e.direction", "e.x")

    x, y = joint_samples(a, b, columns)
    return wasserstein(projected(x), projected(y), "direction").agg(F.avg("distance").alias("distance"))


def energy(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Energy distance of joint samples (256 rows of either at most), zero self-pairs included."""
    def mean(x: DataFrame, y: DataFrame) -> F.Column:
        gap = F.aggregate(F.zip_with("u", "v", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
        return x.select(F.col("v").alias("u")).join(F.broadcast(y)).agg(F.avg(F.sqrt(gap)).alias("m"))

    x, y = (sample.select(F.array(*columns).alias("v")) for sample in joint_samples(a, b, columns))
    m = mean(x, y).withColumnRenamed("m", "xy").join(mean(x, x).withColumnRenamed("m", "xx")).join(mean(y, y).withColumnRenamed("m", "yy"))
    return m.select(F.sqrt(F.greatest(F.lit(0.0), 2 * F.col("xy") - F.col("xx") - F.col("yy"))).alias("distance"))
