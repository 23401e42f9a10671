"""Descriptive metrics of return paths: moments, safe correlations, exact quantiles, tails, serial dependence, drawdowns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.sources.standin import ROLES

#: Periods a year.
PERIODS = {"monthly": 12, "daily": 252}
PAIRS = list(combinations(ROLES, 2))


def higher_quantile(values: Column, p: float) -> Column:
    """The order statistic at ceil(p * (n - 1)), no interpolation; values is an array."""
    return F.get(F.array_sort(values), F.ceil(F.lit(p) * (F.size(values) - 1)).cast("int"))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or missing."""
    return F.coalesce(F.when(b != 0, a / b), F.lit(0.0))


def correlation(x: str, y: str) -> Column:
    """Aggregate correlation: 0 if a side is constant, clipped to [-1, 1]."""
    return F.greatest(F.least(safe_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y)), F.lit(1.0)), F.lit(-1.0))


def base_metrics(paths: DataFrame, periods: int = 12) -> DataFrame:
    """Annualised mean and volatility per path and role; paths (path_id, period_index, role, r)."""
    return paths.groupBy("path_id", "role").agg(
        F.count("*").alias("n"), (F.avg("r") * periods).alias("annual_mean"), (F.stddev_samp("r") * F.sqrt(F.lit(float(periods)))).alias("annual_volatility"),
        F.min("r").alias("worst"), F.max("r").alias("best"),
    )


def covariances(wide: DataFrame) -> DataFrame:
    return wide.groupBy("path_id").agg(*[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in [*PAIRS, *[(r, r) for r in ROLES]]])


def correlations(wide: DataFrame) -> DataFrame:
    return wide.groupBy("path_id").agg(*[correlation(a, b).alias(f"corr_{a}_{b}") for a, b in PAIRS])


def quantiles(paths: DataFrame, points: list[float]) -> DataFrame:
    v = F.collect_list("r")
    g = paths.groupBy("path_id", "role").agg(v.alias("v"))
    return g.select("path_id", "role", *[higher_quantile(F.col("v"), p).alias(f"hq_{round(p * 100):02d}") for p in points])


def tail_means(paths: DataFrame, low: float, high: float) -> DataFrame:
    """Means of the values at or beyond the higher quantiles, inclusive."""
    ends = quantiles(paths, [low, high]).toDF("path_id", "role", "lo", "hi")
    j = paths.join(ends, ["path_id", "role"])
    return j.groupBy("path_id", "role").agg(F.avg(F.when(F.col("r") <= F.col("lo"), F.col("r"))).alias("lower_mean"), F.avg(F.when(F.col("r") >= F.col("hi"), F.col("r"))).alias("upper_mean"))


def autocorrelations(paths: DataFrame, lags: list[int], transform=lambda x: x) -> DataFrame:
    """Full-sample mean and denominator; 0 for constant series. (path_id, role, lag, acf)."""
    w = Window.partitionBy("path_id", "role")
    c = paths.withColumn("x", transform(F.col("r"))).withColumn("c", F.col("x") - F.avg("x").over(w))
    o = w.orderBy("period_index")
    for k in lags:
        c = c.withColumn(f"l{k}", F.lag("c", k).over(o))
    sums = c.groupBy("path_id", "role").agg(F.sum(F.col("c") * F.col("c")).alias("d"), *[F.sum(F.col("c") * F.col(f"l{k}")).alias(f"s{k}") for k in lags])
    return sums.select("path_id", "role", F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), safe_divide(F.col(f"s{k}"), F.col("d")).alias("acf")) for k in lags])).alias("x")).select("path_id", "role", "x.lag", "x.acf")


def gap_aware_autocorrelation(paths: DataFrame, lag: int) -> DataFrame:
    """Pairs inside one segment_id only; the denominator is that of the available pairs."""
    w = Window.partitionBy("path_id", "role")
    o = w.orderBy("period_index")
    c = paths.withColumn("c", F.col("r") - F.avg("r").over(w))
    c = c.withColumn("b", F.lag("c", lag).over(o)).withColumn("sb", F.lag("segment_id", lag).over(o)).where("sb = segment_id")
    g = c.groupBy("path_id", "role").agg(F.sum(F.col("c") * F.col("b")).alias("n"), F.sum(F.col("c") * F.col("c")).alias("p"), F.sum(F.col("b") * F.col("b")).alias("q"), F.count("*").alias("pairs"))
    return g.select("path_id", "role", "pairs", safe_divide(F.col("n"), F.sqrt(F.col("p") * F.col("q"))).alias("acf"))


def cross_lag(wide: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of a at t with b at t + 1, each side demeaned on its own n - 1 rows."""
    x = wide.withColumn("y", F.lead(b).over(Window.partitionBy("path_id").orderBy("period_index"))).where("y IS NOT NULL")
    return x.groupBy("path_id").agg(correlation(a, "y").alias("cross_lag"))


def cross_lag_block(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Per path, the correlations of every column at t with every column at t + 1."""
    o = Window.partitionBy("path_id").orderBy("period_index")
    y = wide.select("path_id", *columns, *[F.lead(c).over(o).alias(f"__{c}") for c in columns])
    each = [F.struct(F.lit(a).alias("early"), F.lit(b).alias("late"), F.col(a).alias("x"), F.col(f"__{b}").alias("y")) for a in columns for b in columns]
    pairs = y.where(F.col(f"__{columns[0]}").isNotNull()).select("path_id", F.explode(F.array(*each)).alias("e")).select("path_id", "e.*")
    return pairs.groupBy("path_id", "early", "late").agg(F.corr("x", "y").alias("c"))


def cross_lag_gap(blocks: DataFrame, reference: DataFrame) -> DataFrame:
    """Largest gap of each path's block to the reference path's."""
    known = reference.select("early", "late", F.col("c").alias("r"))
    return blocks.join(known, ["early", "late"]).groupBy("path_id").agg(F.max(F.abs(F.col("c") - F.col("r"))).alias("gap"))


def drawdowns(paths: DataFrame) -> DataFrame:
    """Depth 1 - exp(lowest log wealth under its peak, peak from 0) and the longest run of rows under the peak."""
    o = Window.partitionBy("path_id", "role").orderBy("period_index")
    upto = o.rowsBetween(Window.unboundedPreceding, 0)
    p = paths.withColumn("wealth", F.sum("r").over(upto)).withColumn("peak", F.greatest(F.lit(0.0), F.max("wealth").over(upto)))
    p = p.withColumn("under", F.col("wealth") < F.col("peak")).withColumn("run", F.sum(F.when(F.col("under"), 0).otherwise(1)).over(upto))
    runs = p.groupBy("path_id", "role", "run").agg(F.min(F.col("wealth") - F.col("peak")).alias("low"), F.count_if("under").alias("length"))
    return runs.groupBy("path_id", "role").agg((1 - F.exp(F.min("low"))).alias("depth"), F.max("length").alias("duration"))


def rolling_sums(paths: DataFrame, width: int) -> DataFrame:
    """Trailing sums over full frames only."""
    o = Window.partitionBy("path_id", "role").orderBy("period_index").rowsBetween(-(width - 1), 0)
    return paths.withColumn("total", F.sum("r").over(o)).withColumn("k", F.count("*").over(o)).where(F.col("k") == width).drop("k")


def coexceedance(wide: DataFrame, p: float = 0.10) -> DataFrame:
    """Share of rows where both assets are at or under their own higher quantile."""
    q = wide.groupBy("path_id").agg(*[higher_quantile(F.collect_list(r), p).alias(f"q_{r}") for r in ROLES])
    j = wide.join(q, "path_id")
    return j.groupBy("path_id").agg(*[F.avg(((F.col(a) <= F.col(f"q_{a}")) & (F.col(b) <= F.col(f"q_{b}"))).cast("double")).alias(f"co_{a}_{b}") for a, b in PAIRS])


def roll_up(monthly: DataFrame, months: int) -> DataFrame:
    """Sums of monthly values over full buckets of so many months."""
    bucket = F.floor((F.col("period_index") - 1) / months) + 1
    g = monthly.groupBy("path_id", bucket.alias("bucket")).agg(F.count("*").alias("k"), *[F.sum(r).alias(r) for r in ROLES])
    return g.where(F.col("k") == months).drop("k")
