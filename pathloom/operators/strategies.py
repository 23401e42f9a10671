"""Trading-rule operators: trailing features, winner and inverse-volatility weights, held decisions, Sharpe ratios, memorisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.sources.standin import ROLES


def _prior(width: int):
    return Window.partitionBy("path_id").orderBy("period_index").rowsBetween(-width, -1)


def trailing_features(wide: DataFrame) -> DataFrame:
    """1- and 6-period sums, the log level's distance from its 12-period mean and the 6-period spread: strictly prior rows,
    full frames only."""
    out = wide
    level = Window.partitionBy("path_id").orderBy("period_index")
    for r in ROLES:
        for k in (1, 6):
            out = out.withColumn(f"{r}_{k}", F.sum(r).over(_prior(k)))
        out = out.withColumn(f"__{r}", F.sum(r).over(level.rowsBetween(Window.unboundedPreceding, 0)))
        out = out.withColumn(f"{r}_trend", F.lag(f"__{r}").over(level) - F.avg(f"__{r}").over(_prior(12))).drop(f"__{r}")
    out = out.withColumn("spread_6", F.sum(F.col("taxable_bond") - F.col("muni_bond")).over(_prior(6)))
    return out.withColumn("k", F.count("*").over(_prior(12))).where("k = 12").drop("k")


def winner_weights(features: DataFrame, suffix: str) -> DataFrame:
    """All weight on the role with the largest feature, ties split equally."""
    cols = [F.col(f"{r}{suffix}") for r in ROLES]
    best = F.greatest(*cols)
    ties = sum(((c == best).cast("int") for c in cols), F.lit(0))
    return features.select("path_id", "period_index", *[((c == best).cast("double") / ties).alias(f"w_{r}") for r, c in zip(ROLES, cols, strict=True)])


def inverse_volatility_weights(wide: DataFrame, lookback: int = 12, hold: int = 3) -> DataFrame:
    """Weights 1 / trailing volatility of simple returns, decided on every hold-th row and held; wide holds log returns."""
    out = wide.withColumn("k", F.count("*").over(_prior(lookback))).withColumn("bucket", F.floor((F.col("period_index") - 1) / hold))
    inv = {r: F.col(f"i_{r}") for r in ROLES}
    for r in ROLES:
        out = out.withColumn(f"i_{r}", F.when(F.col("k") == lookback, 1 / F.stddev_samp(F.expm1(r)).over(_prior(lookback))))
    total = sum(inv.values(), F.lit(0.0))
    w = Window.partitionBy("path_id", "bucket").orderBy("period_index")
    held = [F.first(inv[r] / total).over(w).alias(f"w_{r}") for r in ROLES]
    return out.select("path_id", "period_index", *ROLES, *held).na.drop("any", subset=[f"w_{r}" for r in ROLES])


def timer_improvements(weights: DataFrame, periods: int = 12) -> DataFrame:
    """Per path: Sharpe ratio of the timer's simple returns, that of the mean weights held throughout, and their difference."""
    mean = weights.agg(*[F.avg(f"w_{r}").alias(f"c_{r}") for r in ROLES])
    total = sum((F.col(f"c_{r}") for r in ROLES), F.lit(0.0))
    simple = lambda w: sum((F.expm1(r) * w(r) for r in ROLES), F.lit(0.0))
    x = weights.crossJoin(F.broadcast(mean)).select("path_id", simple(lambda r: F.col(f"w_{r}")).alias("timer"), (simple(lambda r: F.col(f"c_{r}")) / total).alias("static"))
    ratio = lambda c: F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(float(periods)))
    both = x.groupBy("path_id").agg(ratio("timer").alias("timer"), ratio("static").alias("static"))
    return both.withColumn("improvement", F.col("timer") - F.col("static"))


def sharpe(returns: DataFrame, column: str, periods: int = 12) -> DataFrame:
    return returns.groupBy("path_id").agg((F.avg(column) / F.stddev_samp(column) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def directional_sharpes(wide: DataFrame, periods: int = 12) -> DataFrame:
    """For each predictor and outcome: Sharpe of the outcome times the predictor's last sign, zero counting as up."""
    o = Window.partitionBy("path_id").orderBy("period_index")
    out = wide
    for a in ROLES:
        out = out.withColumn(f"s_{a}", F.lag(F.when(F.col(a) >= 0, 1.0).otherwise(-1.0)).over(o))
    each = [F.struct(F.lit(a).alias("predictor"), F.lit(b).alias("outcome"), (F.col(f"s_{a}") * F.col(b)).alias("x")) for a in ROLES for b in ROLES]
    long = out.select("path_id", F.explode(F.array(*each)).alias("e")).select("path_id", "e.*").where("x IS NOT NULL")
    return long.groupBy("path_id", "predictor", "outcome").agg((F.avg("x") / F.stddev_samp("x") * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def memorisation_hits(states: DataFrame, column: str, width: int) -> DataFrame:
    """Rows whose last width values stood before in the same path, always with one and the same next value."""
    o = Window.partitionBy("path_id").orderBy("period_index")
    w = states.withColumn("key", F.concat_ws(",", F.collect_list(F.col(column).cast("string")).over(o.rowsBetween(-width, -1)))).withColumn("k", F.count("*").over(o.rowsBetween(-width, -1))).where(F.col("k") == width)
    before = Window.partitionBy("path_id", "key").orderBy("period_index").rowsBetween(Window.unboundedPreceding, -1)
    seen = w.withColumn("lo", F.min(column).over(before)).withColumn("hi", F.max(column).over(before))
    return seen.select("path_id", "period_index", (F.col("lo") == F.col("hi")).alias("known"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("guess"), F.col(column).alias("actual"))


def gram(features: DataFrame, columns: list[str], outcome: str) -> DataFrame:
    """Moment sums for a ridge fit: one aggregate pass, the small solve happens on the driver."""
    x = ["one", *columns]
    f = features.withColumn("one", F.lit(1.0))
    return f.agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(x) for b in x[i:]], *[F.sum(F.col(a) * F.col(outcome)).alias(f"{a}|y") for a in x])


def ridge(features: DataFrame, columns: list[str], outcome: str, penalty: float = 1.0) -> list[float]:
    """(X'X/n + diag(0, penalty, ...)) b = X'y/n on z-scored features (population deviations), intercept first."""
    import numpy as np

    stats = features.agg(*[F.avg(c).alias(f"m|{c}") for c in columns], *[F.stddev_pop(c).alias(f"s|{c}") for c in columns]).first()
    z = features.select(outcome, *[((F.col(c) - stats[f"m|{c}"]) / stats[f"s|{c}"]).alias(c) for c in columns])
    g = gram(z, columns, outcome).first()
    x = ["one", *columns]
    a = np.array([[g[f"{p}|{q}"] if i <= j else g[f"{q}|{p}"] for j, q in enumerate(x)] for i, p in enumerate(x)]) / g["n"]
    y = np.array([g[f"{p}|y"] for p in x]) / g["n"]
    return np.linalg.solve(a + np.diag([0.0] + [penalty] * len(columns)), y).tolist()
