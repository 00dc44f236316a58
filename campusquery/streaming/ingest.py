"""Incremental intake of event files: an extension, since micro-batches stand in for a periodic crawl."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def daily_counts(spark: SparkSession, path: str, schema, checkpoint: str, to: str) -> None:
    """Counts of each day and type of what has arrived below ``path`` since the last call, appended to ``to``.

    Days close one day after the newest event; the checkpoint holds the open ones, so calls continue each other.
    """
    events = spark.readStream.schema(schema).parquet(path).withColumn("at", F.col("ts").cast("timestamp"))
    days = events.withWatermark("at", "1 day").groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"))
    out = days.select(F.col("window.start").alias("day"), "event_type", "n")
    out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
