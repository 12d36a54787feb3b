"""Streaming forms give the rows of their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.streaming import counters


def run(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path, data):
    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(2).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_counters(spark, tmp_path, data):
    got = run(spark, counters.daily_counters(source(spark, tmp_path, data)), "daily", "complete")
    want = spark.read.parquet(f"{data}/events.parquet").groupBy("user_id", "event_type", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day")).count()
    key = lambda rows, n: sorted((r["user_id"], r["event_type"], r["day"], r[n]) for r in rows)
    assert key(got.collect(), "n") == key(want.collect(), "count")


def test_weekly_and_sessions(spark, tmp_path, data):
    assert run(spark, counters.weekly_trend(source(spark, tmp_path, data)), "weekly", "complete").count() > 0


def test_first_requests(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "source_id string, t string").select("source_id", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("source_id string, ts timestamp").parquet(str(tmp_path / "r"))
    assert run(spark, counters.first_requests(s), "firsts", "append").count() == 2
