"""Incremental operators as Structured Streaming queries: exact duplicate counts, moments by event-time window, append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of a folder, some at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(folder)


def windowed_moments(events: DataFrame, time: str, value: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count, mean and variance by event-time window; rows later than the watermark are left out."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    return w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance")).select(F.col("w.start").alias("start"), *keys, "n", "mean", "variance")


def duplicate_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """How often each row content was seen, by hash: the state is a count a hash."""
    return rows.groupBy(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).agg(F.count("*").alias("copies"))


def accumulate(stream: DataFrame, reduce, path: str, checkpoint: str):
    """Each micro-batch's partial result appended under its batch id, so a repeated batch replaces its own rows only."""

    def step(batch: DataFrame, batch_id: int) -> None:
        reduce(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
