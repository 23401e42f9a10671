"""Readers, sinks, calendars and streams."""

from datetime import date

from pyspark.sql import functions as F

from pathloom.functions.calendar import easter, holidays, sessions
from pathloom.sources import readers, sinks
from pathloom.streaming import incremental


def test_calendar(spark):
    assert [easter(y) for y in (2000, 2019, 2024, 2038)] == [date(2000, 4, 23), date(2019, 4, 21), date(2024, 3, 31), date(2038, 4, 25)]
    assert date(2021, 12, 31) not in holidays(2022) and date(2022, 1, 1) not in holidays(2022) and date(2023, 1, 2) in holidays(2023)
    got = [str(r.session) for r in sessions(spark, date(2024, 1, 1), date(2024, 1, 5)).collect()]
    assert got == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]
    assert sessions(spark, date(2023, 1, 1), date(2023, 12, 31)).count() == 250


def test_series_and_assets(spark, tmp_path):
    (tmp_path / "s.csv").write_text("d,v\n2024-01-01,1.5\n2024-01-02,.\n2024-01-02,2\n")
    s = readers.read_series_csv(spark, str(tmp_path / "s.csv"), "X")
    assert [r.value for r in s.collect()] == [1.5, None, 2.0] and readers.order_violations(s).count() == 1
    head = "session,open,high,low,close,adj_close,volume,dividends,stock_splits\n"
    (tmp_path / "a.csv").write_text(head + "2024-01-02T05:00:00.000Z,1,1,1,1,1,5,0,0\n")
    assert str(readers.read_asset_csv(spark, str(tmp_path / "a.csv"), "T").first().session) == "2024-01-02"


def test_paths_round_trip(spark, tmp_path):
    rows = [(f"P{p:06d}", i, 1, 1, i, 0.1 * i, -0.0, 1e-17) for p in range(3) for i in range(1, 5)]
    df = spark.createDataFrame(rows, readers.DAILY_SCHEMA)
    sinks.write_csv(df, str(tmp_path / "csv"), 2)
    back = readers.read_paths_csv(spark, str(tmp_path / "csv"), True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    want = df.groupBy("path_id").agg((F.count("*") + 1).alias("n"))
    assert readers.missing_keys(back, want).count() == 3 and readers.non_finite(back, ["equity_log_return"]).count() == 0
    sinks.write_paths(df, str(tmp_path / "pq"), 2)
    sums = sinks.checksums(spark, str(tmp_path / "pq"))
    assert sums.where("path LIKE '%parquet'").count() == 2 and sinks.allowlist_differences(spark, str(tmp_path / "pq"), sums.select("path")).count() == 0
    a, b = sinks.manifest({"x": df, "y": spark.read.parquet(str(tmp_path / "pq"))}).collect()
    assert (a.rows, a.content) == (b.rows, b.content)


def test_streams_equal_batches(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).repartition(6).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(src).schema.simpleString()[7:-1].replace(":", " ")
    stream = incremental.read_events(spark, str(tmp_path / "in"), schema)
    q = incremental.duplicate_counts(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("dups").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.copies for r in spark.table("dups").collect()) == sorted(r["count"] for r in spark.read.parquet(src).groupBy("event_type").count().collect())
    done = incremental.accumulate(stream, lambda b: b.groupBy("event_type").agg(F.count("*").alias("n")), str(tmp_path / "out"), str(tmp_path / "cp"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()
    batch = incremental.windowed_moments(spark.read.parquet(src), "ts", "value", ["event_type"])
    assert batch.agg(F.sum("n")).first()[0] == spark.read.parquet(src).count()
