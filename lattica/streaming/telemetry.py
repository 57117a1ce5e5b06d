"""Telemetry roll-ups, the same for tables and streams.

A stream's daily windows go by event time with a watermark, so results don't depend on when events arrive.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from lattica.functions.text import DURATIONS, bucket
from lattica.sources.storage import children, exists, remove

RETENTION = "7 days"
EVENT = "ts timestamp, command string, success boolean, duration_ms double, error string"


def daily(events: DataFrame) -> DataFrame:
    """Counts, durations by bucket and different errors of each command and day (UTC)."""
    names = DURATIONS[1]
    slot = bucket(F.col("duration_ms"), *DURATIONS)
    by_bucket = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.count_if(slot == n) for n in names)))
    return events.groupBy(F.window("ts", "1 day").alias("w"), "command").agg(F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"), by_bucket.alias("durations"), F.collect_set("error").alias("errors"))


def retained(events: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Events of the last days; those without a time go."""
    return events.filter(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def sink(events: DataFrame, path: str) -> None:
    """Appends events to a folder of JSON lines."""
    events.write.mode("append").json(path)


def source(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder of JSON lines; a line that is none of them gives nulls."""
    return spark.read.schema(EVENT).option("mode", "PERMISSIVE").json(path)


def ready(batches: DataFrame, least: int = 100) -> DataFrame:
    """Days with enough events to be sent."""
    total = batches.groupBy(F.col("w.start").alias("day")).agg(F.sum(F.col("succeeded") + F.col("failed")).alias("events"))
    return total.filter(F.col("events") >= least)


def newest(events: DataFrame, most: int = 1000) -> DataFrame:
    """The newest events, as a bounded buffer holds them."""
    return events.orderBy(F.desc("ts"), "command", "duration_ms").limit(most)


def stream_daily(stream: DataFrame, out: str, checkpoint: str):
    """Starts the daily roll-up of a stream of events into parquet files, closing a day when the watermark passes it; runs over what is there and stops."""
    rolled = daily(stream.withWatermark("ts", RETENTION))
    flat = rolled.select(F.col("w.start").alias("day"), "command", "succeeded", "failed")
    return flat.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_batches(stream: DataFrame, out: str, checkpoint: str, most: int | None = None) -> None:
    """Writes each micro-batch to a folder named by its number, so one that is run again replaces itself; goes on after what the checkpoint has. most: the run breaks off after so many batches."""
    done = []

    def each(batch: DataFrame, number: int) -> None:
        if most is not None and len(done) >= most:
            raise InterruptedError
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if most is None:
            raise


def batches(spark: SparkSession, out: str) -> DataFrame:
    """The rows of all micro-batches, with their batch."""
    return spark.read.parquet(out)


def stream_upserts(stream: DataFrame, key: str, order: str, apply, checkpoint: str):
    """Applies each micro-batch's newest row by key, exactly once for each batch number; apply(rows, batch) writes them."""

    def each(batch: DataFrame, number: int) -> None:
        apply(batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("x")).select("x.*"), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_newest(stream: DataFrame, out: str, checkpoint: str, most: int = 1000) -> None:
    """Keeps the newest events of a stream in a folder for the last micro-batch: the newest of what came and of what the one before kept. A micro-batch that is run again reads the same as before and replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{out}/{number - 1}"
        held = spark.read.schema(batch.schema).parquet(before).unionByName(batch) if number and exists(spark, before) else batch
        newest(held, most).write.mode("overwrite").parquet(f"{out}/{number}")
        if number > 1:
            remove(spark, f"{out}/{number - 2}")  # the one before stays for a repeat

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def kept_newest(spark: SparkSession, out: str) -> DataFrame:
    """The buffer that stream_newest wrote last."""
    return spark.read.parquet(f"{out}/{max(int(n) for n in children(spark, out) if n.isdigit())}")


def stream_sessions(stream: DataFrame, out: str, checkpoint: str, least: int = 100):
    """Starts a stream that emits a batch (day, number, events, whole) of each day for every so many events, and what is left, if any, when the watermark passes the day. Days are states of two numbers; nothing but these is kept."""

    def step(key, parts, state):
        day = key[0]
        pending, number = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.remove()
            rows = [(day, number, pending, False)] if pending else []
        else:
            pending += sum(len(p) for p in parts)
            rows = [(day, number + i, least, True) for i in range(pending // least)]
            state.update((pending % least, number + len(rows)))
            end = int((pd.Timestamp(day) + pd.Timedelta(days=1)).timestamp() * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["day", "number", "events", "whole"]).astype({"number": "int64", "events": "int64"})

    days = stream.withWatermark("ts", RETENTION).filter("ts is not null").select(F.to_date("ts").alias("day"), "ts")
    batches_ = days.groupBy("day").applyInPandasWithState(step, "day date, number long, events long, whole boolean", "pending long, number long", "append", GroupStateTimeout.EventTimeTimeout)
    return batches_.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
