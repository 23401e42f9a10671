"""State paths: islands, episodes, occupancy, transitions, dwell times, conditional means, relabelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_runs(states: DataFrame) -> DataFrame:
    """Adds run, the running number of the episode within its path."""
    o = Window.partitionBy("path_id").orderBy("period_index")
    new = F.coalesce(F.lag("state").over(o) != F.col("state"), F.lit(True))
    return states.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def episodes(states: DataFrame) -> DataFrame:
    return with_runs(states).groupBy("path_id", "run", "state").agg(F.min("period_index").alias("first"), F.max("period_index").alias("last"), F.count("*").alias("length"))


def occupancy(states: DataFrame) -> DataFrame:
    g = states.groupBy("path_id", "state").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("path_id")))


def transitions(states: DataFrame) -> DataFrame:
    o = Window.partitionBy("path_id").orderBy("period_index")
    g = states.withColumn("next", F.lead("state").over(o)).where("next IS NOT NULL").groupBy("state", "next").agg(F.count("*").alias("n"))
    return g.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def dwell(states: DataFrame) -> DataFrame:
    e = episodes(states).groupBy("state").agg(F.count("*").alias("episodes"), F.avg("length").alias("mean_dwell"), F.percentile("length", 0.5).alias("median_dwell"), F.avg((F.col("length") == 1).cast("double")).alias("one_period_share"))
    return e


def survival(states: DataFrame, upto: int = 12) -> DataFrame:
    e = episodes(states).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(upto))))
    return e.groupBy("state", F.col("m").cast("long").alias("months")).agg(F.avg((F.col("length") >= F.col("m")).cast("double")).alias("survival"))


def conditional_means(states: DataFrame, columns: list[str]) -> DataFrame:
    return states.groupBy("state").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def canonical_labels(states: DataFrame, columns: list[str]) -> DataFrame:
    """state -> canonical, by the lexicographic order of the state's means."""
    m = conditional_means(states, columns)
    return m.select("state", (F.row_number().over(Window.orderBy(*columns, "state")) - 1).cast("long").alias("canonical"))


def support(states: DataFrame, length: int) -> DataFrame:
    """Completed episodes, with a change of state on either side, and starts whose next length rows stay in the state."""
    e = episodes(states)
    ends = Window.partitionBy("path_id")
    e = e.withColumn("inside", (F.col("first") > F.min("first").over(ends)) & (F.col("last") < F.max("last").over(ends)))
    return e.groupBy("state").agg(F.count_if("inside").alias("episodes"), F.sum(F.greatest(F.col("length") - length + 1, F.lit(0))).alias("eligible_starts"))


def realized_blocks(states: DataFrame, boundary: str) -> DataFrame:
    """Block lengths by state from boundary flags: a block starts where boundary is true."""
    o = Window.partitionBy("path_id").orderBy("period_index").rowsBetween(Window.unboundedPreceding, 0)
    b = states.withColumn("block", F.sum(F.col(boundary).cast("int")).over(o)).groupBy("path_id", "block", "state").agg(F.count("*").alias("length"))
    return b.groupBy("state").agg(F.count("*").alias("blocks"), F.avg("length").alias("mean_length"), F.avg((F.col("length") == 1).cast("double")).alias("singleton_share"))
