"""Simultaneous inference: Holm, plus-one p-values, max-statistics, exact binomial intervals, bootstrap gaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.operators.metrics import higher_quantile


def holm(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """cells (name, p): adjusted p (monotone) and step-down decision, ties by name."""
    m = F.count("*").over(Window.partitionBy())
    o = Window.orderBy("p", "name")
    r = cells.withColumn("rank", F.row_number().over(o).cast("long")).withColumn("m", m)
    step = F.least(F.col("p") * (F.col("m") - F.col("rank") + 1), F.lit(1.0))
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("p") <= F.lit(alpha) / (F.col("m") - F.col("rank") + 1)
    return r.select("name", "p", "rank", F.max(step).over(upto).alias("adjusted_p"), F.bool_and(ok).over(upto).alias("rejected"))


def plus_one_p(replicates: DataFrame, observed: DataFrame, by: str) -> DataFrame:
    """(1 + replicates at or over the observed value) / (replicates + 1), for each group."""
    j = replicates.join(observed, by)
    return j.groupBy(by).agg(((1 + F.count_if(F.col("x") >= F.col("observed"))) / (F.count("*") + 1)).alias("p"))


def max_z(replicates: DataFrame, observed: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Two-sided max-z cell: replicates (replicate, component, x), observed (component, observed).

    Components whose replicates do not vary must match exactly and are left out of the maximum.
    """
    scale = replicates.groupBy("component").agg(F.avg("x").alias("centre"), F.stddev_samp("x").alias("scale"))
    live = scale.where(F.col("scale") > tolerance)
    stat = observed.join(live, "component").agg(F.max(F.abs((F.col("observed") - F.col("centre")) / F.col("scale"))).alias("statistic"))
    each = replicates.join(live, "component").groupBy("replicate").agg(F.max(F.abs((F.col("x") - F.col("centre")) / F.col("scale"))).alias("z"))
    return each.join(F.broadcast(stat)).groupBy("statistic").agg(((1 + F.count_if(F.col("z") >= F.col("statistic"))) / (F.count("*") + 1)).alias("p"), F.count("*").alias("replicates"))


def critical_values(replicates: DataFrame, by: str, probability: float) -> DataFrame:
    return replicates.groupBy(by).agg(F.collect_list("x").alias("v")).select(by, higher_quantile(F.col("v"), probability).alias("critical"))


def grouped_comparison(q: DataFrame, c: DataFrame, nulls: DataFrame) -> DataFrame:
    """Mean gap of two samples by endpoint, against the spread of resampled gaps (endpoint, replicate, gap)."""
    gap = q.groupBy("endpoint").agg(F.avg("x").alias("a")).join(c.groupBy("endpoint").agg(F.avg("x").alias("b")), "endpoint")
    scale = nulls.groupBy("endpoint").agg(F.stddev_samp("gap").alias("scale"))
    return gap.join(scale, "endpoint").select("endpoint", ((F.col("a") - F.col("b")) / F.col("scale")).alias("z"))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            total *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if incomplete_beta(a, b, mid) < p else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(successes: int, trials: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact binomial interval."""
    tail = (1 - confidence) / 2
    low = 0.0 if successes == 0 else beta_quantile(tail, successes, trials - successes + 1)
    high = 1.0 if successes == trials else beta_quantile(1 - tail, successes + 1, trials - successes)
    return low, high
