"""Windowed counts with a watermark over an event stream, in bounded state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours", time: str = "ts") -> DataFrame:
    """Events and value totals by window and type; rows later than the watermark are dropped by Spark. Works on batches too."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Append-only Parquet log of a stream, one pass over what is there."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
