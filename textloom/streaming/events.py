"""Streaming extensions: windowed aggregates, a drop folder of uploads, metric refresh.

The same functions take batch and streaming tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hourly(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling hours; late rows beyond the watermark go."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n) of sessions parted by `gap`."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "n")


def decode_uploads(messages: DataFrame, column: str = "value") -> DataFrame:
    """Data URLs (header, comma, base64) as bytes, and the words of the header's tail."""
    part = F.split(column, ",")
    return messages.select(F.unbase64(F.get(part, F.lit(1))).alias("content"), F.size(F.split(F.get(part, F.lit(0)), "\\s+")).alias("words"))


def drop_folder(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """An endless stream of the JSON-lines shards that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def refresh(stream: DataFrame, metric: Callable[[DataFrame], DataFrame], table: str, checkpoint: str):
    """Writes metric(batch) of every micro-batch, as Parquet with its batch number."""

    def each(batch: DataFrame, number: int) -> None:
        metric(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
