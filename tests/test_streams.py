"""Streams of telemetry in small batches, broken off and gone on with, give what the batch queries give."""

import random

from pyspark.sql import functions as F

from lattica.streaming import telemetry as R


def events(spark, n=2600, days=9):
    rng = random.Random(4)
    rows = [(1_700_000_000 + rng.randrange(days * 86400) + rng.random(), rng.choice(["list", "show"]), True, float(i), None) for i in range(n)]
    return spark.createDataFrame(rows, "t double, command string, success boolean, duration_ms double, error string").select(F.timestamp_seconds("t").alias("ts"), "command", "success", "duration_ms", "error")


def parts(spark, path, rows, n, first=0):
    """Files that a stream reads one after the other."""
    for i in range(n):
        rows.filter(F.col("duration_ms") % n == i).coalesce(1).write.mode("append").parquet(f"{path}/{first + i}")


def stream(spark, path):
    return spark.readStream.schema(R.EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_bounded_buffer(spark, tmp_path):
    rows, folder = events(spark), str(tmp_path / "in")
    parts(spark, folder, rows.filter("duration_ms < 1800"), 4)
    for _ in range(2):
        R.stream_newest(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "check"), 1000)
        parts(spark, folder, rows.filter("duration_ms >= 1800"), 2, 10) if _ == 0 else None
    got = R.kept_newest(spark, str(tmp_path / "out"))
    assert sorted(r["duration_ms"] for r in got.collect()) == sorted(r["duration_ms"] for r in R.newest(rows, 1000).collect())


def test_batches_of_a_hundred(spark, tmp_path):
    rows, folder = events(spark), str(tmp_path / "in")
    by_time = rows.withColumn("day", F.to_date("ts"))
    days = sorted(r["day"] for r in by_time.select("day").distinct().collect())
    for i, d in enumerate(days):  # in order of days, so that none is late
        by_time.filter(F.col("day") == F.lit(d)).drop("day").coalesce(1).write.parquet(f"{folder}/{i}")
        if i in (3, len(days) - 1):
            R.stream_sessions(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    far = spark.createDataFrame([("list",)], "command string").select((F.lit(max(days)).cast("timestamp") + F.expr("interval 30 days")).alias("ts"), "command", F.lit(True).alias("success"), F.lit(0.0).alias("duration_ms"), F.lit(None).cast("string").alias("error"))
    far.coalesce(1).write.parquet(f"{folder}/far")
    R.stream_sessions(stream(spark, folder), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).filter(F.col("day") <= F.lit(max(days))).collect()
    for r in by_time.groupBy("day").count().collect():
        own = sorted((x["number"], x["events"], x["whole"]) for x in got if x["day"] == r["day"])
        whole, rest = divmod(r["count"], 100)
        assert own == [(i, 100, True) for i in range(whole)] + [(whole, rest, False)] * bool(rest)
