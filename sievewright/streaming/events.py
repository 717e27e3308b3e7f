"""The event log as a stream: sessions and progress folds, equal to their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """``(user_id, start, end, n)`` per run of a user's events without a pause of ``gap``; batch or stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    s = source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("last").alias("end"), "n")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_once(spark: SparkSession, folder: str, schema: str, build, out: str, checkpoint: str) -> None:
    """Reads what is in ``folder`` as a stream, to the end, and writes ``build(stream)`` as Parquet."""
    stream = spark.readStream.schema(schema).parquet(folder)
    query = build(stream).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
