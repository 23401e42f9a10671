"""Alignment on an expected calendar, without imputation: gaps, returns, coverage, complete months, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.sources.standin import ROLES

#: The absolute simple return above which a move is flagged, and the factor move likewise.
LARGE_MOVE = {"equity": 0.20, "muni_bond": 0.10, "taxable_bond": 0.10}
FACTOR_MOVE = 0.05


def numeric(c: Column) -> Column:
    return c.try_cast("double")


def observed(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (price != float("inf")) & (price > 0)


def align(calendar: DataFrame, prices: DataFrame) -> DataFrame:
    """Every expected session of every role; price null where it is not observed; in_range and gap flags."""
    grid = calendar.withColumn("role", F.explode(F.array(*[F.lit(r) for r in ROLES])))
    seen = prices.select("session", "role", numeric(F.col("price")).alias("price"))
    out = grid.join(seen, ["session", "role"], "left")
    out = out.withColumn("observed", F.coalesce(observed(F.col("price")), F.lit(False)))
    w = Window.partitionBy("role")
    when = F.when(F.col("observed"), F.col("session"))
    out = out.withColumn("in_range", F.coalesce(F.col("session").between(F.min(when).over(w), F.max(when).over(w)), F.lit(False)))
    return out.withColumn("gap", F.col("in_range") & ~F.col("observed")).withColumn("price", F.when(F.col("observed"), F.col("price")))


def session_returns(aligned: DataFrame) -> DataFrame:
    """One-session log returns; null unless both adjacent expected sessions are observed."""
    w = Window.partitionBy("role").orderBy("session")
    return aligned.withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(w))


def synchronized(returns: DataFrame) -> DataFrame:
    """One row a session with all three returns; sessions that lack any are dropped."""
    return returns.groupBy("session", "month", "session_no").pivot("role", ROLES).agg(F.first("r")).na.drop("any", subset=ROLES)


def month_coverage(returns: DataFrame) -> DataFrame:
    """Expected and valid sessions a month; complete when every session has all returns."""
    per = returns.groupBy("month", "session").agg(F.bool_and(F.col("r").isNotNull()).alias("valid"))
    got = per.groupBy("month").agg(F.count("*").alias("expected_sessions"), F.count_if("valid").alias("valid_sessions"))
    return got.withColumn("complete", F.col("expected_sessions") == F.col("valid_sessions"))


def complete_month_returns(returns: DataFrame) -> DataFrame:
    months = month_coverage(returns).where("complete").select("month")
    return synchronized(returns).join(months, "month", "left_semi").groupBy("month").agg(*[F.sum(r).alias(r) for r in ROLES])


def direct_month_returns(aligned: DataFrame, months: DataFrame) -> DataFrame:
    """ln(last price) - ln(price on the session before the first), for complete months."""
    w = Window.partitionBy("role").orderBy("session")
    prior = aligned.withColumn("prior", F.lag("price").over(w))
    ends = prior.groupBy("month", "role").agg(F.min_by("prior", "session").alias("p0"), F.max_by("price", "session").alias("p1"))
    return ends.join(months, "month", "left_semi").select("month", "role", (F.ln("p1") - F.ln("p0")).alias("direct"))


def outlier_flags(returns: DataFrame) -> DataFrame:
    limit = F.lit(None).cast("double")
    for name, value in LARGE_MOVE.items():
        limit = F.when(F.col("role") == name, value).otherwise(limit)
    simple = F.expm1("r")
    return returns.where(F.abs(simple) > limit).select("session", "role", simple.alias("simple_return"))


def continuation(months: DataFrame) -> DataFrame:
    """Month ordinals since 1970-01, whether each continues the one before, and the running segment."""
    ordinal = (F.substring("month", 1, 4).cast("int") - 1970) * 12 + F.substring("month", 6, 2).cast("int") - 1
    w = Window.orderBy("month")
    out = months.withColumn("ordinal", ordinal.cast("long"))
    out = out.withColumn("continues", F.coalesce(F.col("ordinal") - F.lag("ordinal").over(w) == 1, F.lit(False)))
    return out.withColumn("segment_id", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def month_offsets(returns: DataFrame) -> DataFrame:
    """Start offset and length of each complete month in the stacked daily library."""
    months = month_coverage(returns).where("complete")
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return months.select("month", F.col("expected_sessions").alias("sessions"), (F.sum("expected_sessions").over(w) - F.col("expected_sessions")).alias("start_offset"))
