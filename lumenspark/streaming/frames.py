"""Frames that arrive over time (an extension of ours): incremental renders and statistics by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "px long, ts timestamp, sun int, dsn int"


def read_frames(spark: SparkSession, folder: str, watermark: str = "1 day", files_per_trigger: int = 64) -> DataFrame:
    """Frames of a folder as a stream; a pixel's frame that arrives twice within the watermark counts once."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["px", "ts"])


def windowed_shares(frames: DataFrame, contact_at_least: int, window: str = "1 day") -> DataFrame:
    """Per pixel and tumbling window: frames, lit and contact counts and the sum of sun bytes; late frames up to the
    watermark still count."""
    lit, contact = F.col("sun") > 0, F.col("dsn") >= contact_at_least
    return frames.groupBy(F.window("ts", window), "px").agg(F.count("*").alias("n"), F.count_if(lit).alias("n_lit"), F.count_if(contact).alias("n_contact"), F.sum("sun").alias("sum_sun")).select(F.col("window.start").alias("start"), "px", "n", "n_lit", "n_contact", "sum_sun")


def run_once(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes everything that is there and stops: the next call goes on where this one ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder).awaitTermination()
