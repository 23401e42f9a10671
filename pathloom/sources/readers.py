"""Scans of landed provider tables and of exported path tables, with explicit schemas and checks as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The raw asset columns and the consumer columns of exported paths.
ASSET_SCHEMA = "session timestamp, open double, high double, low double, close double, adj_close double, volume bigint, dividends double, stock_splits double"
DAILY_SCHEMA = "path_id string, period_index long, simulation_year long, model_month long, session_in_month long, equity_log_return double, muni_bond_log_return double, taxable_bond_log_return double"
COARSE_SCHEMA = "path_id string, period_index long, simulation_year long, period_in_year long, equity_log_return double, muni_bond_log_return double, taxable_bond_log_return double"


def read_asset_csv(spark: SparkSession, path: str, ticker: str, zone: str = "America/New_York") -> DataFrame:
    """One ticker's history; a bad row is an error. Sessions are dates of the exchange's own zone."""
    raw = spark.read.csv(path, schema=ASSET_SCHEMA, header=True, mode="FAILFAST", enforceSchema=False)
    return raw.withColumn("session", F.to_date(F.from_utc_timestamp("session", zone))).withColumn("ticker", F.lit(ticker))


def read_series_csv(spark: SparkSession, path: str, series_id: str) -> DataFrame:
    """A two-column macro series; ``.`` is the null token."""
    raw = spark.read.csv(path, schema="obs_date date, value double", header=True, nullValue=".", mode="FAILFAST")
    return raw.withColumn("series_id", F.lit(series_id))


def order_violations(series: DataFrame) -> DataFrame:
    """Dates that repeat or do not increase in file order are a fault of the landed table: (series_id, obs_date, n)."""
    return series.groupBy("series_id", "obs_date").agg(F.count("*").alias("n")).where("n > 1 OR obs_date IS NULL")


def read_paths_csv(spark: SparkSession, path: str, daily: bool) -> DataFrame:
    return spark.read.csv(path, schema=DAILY_SCHEMA if daily else COARSE_SCHEMA, header=True, enforceSchema=False, mode="FAILFAST")


def missing_keys(paths: DataFrame, rows_per_path: DataFrame) -> DataFrame:
    """Expected (path_id, period_index) that the table lacks; rows_per_path (path_id, n)."""
    want = rows_per_path.select("path_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("period_index"))
    return want.join(paths, ["path_id", "period_index"], "left_anti")


def non_finite(paths: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    return paths.where(bad)


def month_library(daily: DataFrame) -> DataFrame:
    """(source_month, session_in_month, roles) from a synchronized daily table with session and month."""
    n = F.row_number().over(Window.partitionBy("month").orderBy("session")).cast("long")
    return daily.select(F.col("month").alias("source_month"), n.alias("session_in_month"), "equity", "muni_bond", "taxable_bond")
