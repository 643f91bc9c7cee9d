"""Streams: windows over late events, sessions, and sweeps in micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noticeworks.operators.sweep import carry_forward
from noticeworks.storage import spool


def read_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed(events: DataFrame, *, window: str = "1 day", slide: str | None = None, late: str = "2 days", ts: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Counts and sums by event-time window and key; the same plan for batches and streams. Rows later than the watermark are dropped from a stream."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", *, late: str = "1 day", ts: str = "ts", user: str = "user_id") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n_events"))
    return out.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """All that is there, into a table in memory; for tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def sweep_stream(stream: DataFrame, state: str, checkpoint: str, key: str = "institution_id") -> StreamingQuery:
    """Keeps the last good rows of each source: a batch replaces the sources it has rows of, all others are carried forward.

    State lies in numbered folders ``state``/v=<batch>, so that a batch that is run
    again after a failure writes the same folder from the same one before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = spool(batch, "batch")
        if number > 0:
            before = spark.read.parquet(f"{state}/v={number - 1}").drop("carried")
            rows = carry_forward(rows, before, key)
        else:
            rows = rows.withColumn("carried", F.lit(False))
        rows.write.mode("overwrite").parquet(f"{state}/v={number}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
