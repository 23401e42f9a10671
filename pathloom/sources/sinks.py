"""Sinks: write-once Parquet tables with a manifest, CSV export, checksums of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_paths(paths: DataFrame, root: str, files: int, partitions: tuple[str, ...] = ()) -> None:
    """Whole paths in key order, never over an existing table; Spark's committer publishes all files or none."""
    out = paths.repartitionByRange(files, "path_id").sortWithinPartitions("path_id", "period_index")
    out.write.mode("errorifexists").partitionBy(*partitions).parquet(root)


def write_csv(paths: DataFrame, root: str, files: int) -> None:
    """CSV export with the shortest text that reads back to the same double; negative zero as zero."""
    named = [format_double(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in paths.dtypes]
    paths.repartitionByRange(files, "path_id").sortWithinPartitions("path_id", "period_index").select(*named).write.mode("errorifexists").csv(root, header=True)


def format_double(c: F.Column) -> F.Column:
    return F.when(c == 0, F.lit("0")).otherwise(c.cast("string"))


def checksums(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256) of every file under root, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a table: name, rows and a content id that does not depend on row order."""
    out = None
    for name, df in tables.items():
        h = F.xxhash64(*[F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)) if isinstance(t.dataType, T.DoubleType) else F.col(c) for c, t in zip(df.columns, df.schema.fields, strict=True)])
        row = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).cast("string").alias("content"))
        out = row if out is None else out.unionByName(row)
    return out


def allowlist_differences(spark: SparkSession, root: str, recorded: DataFrame) -> DataFrame:
    """Files on disk without a record and records without a file; recorded (path)."""
    disk = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    extra = disk.join(recorded, "path", "left_anti").select("path", F.lit("not recorded").alias("fault"))
    return extra.unionByName(recorded.join(disk, "path", "left_anti").select("path", F.lit("missing").alias("fault")))
