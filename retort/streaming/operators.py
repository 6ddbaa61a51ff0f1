"""The operators that make sense on streams. Map and filter operators (columns, filters, molecule columns, fingerprints) run
on a streaming DataFrame as they are; these keep state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def deduplicate(df: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key that comes. With event_time, keys are forgotten after the delay, so state stays bounded."""
    if event_time is None:
        return df.dropDuplicates([key])
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def running_frequencies(df: DataFrame, key: str) -> DataFrame:
    """key and count so far, for output mode complete or update."""
    return df.groupBy(key).agg(F.count("*").alias("count"))


def windowed_statistics(df: DataFrame, event_time: str, value: str, by: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """count, mean, min and max of value by window and key; late rows are taken up to the delay."""
    rows = df.withWatermark(event_time, delay)
    out = rows.groupBy(F.window(event_time, width), by).agg(F.count("*").alias("count"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("start"), by, "count", "mean", "min", "max")


def run_available(spark: SparkSession, df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, for tests and backfills."""
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
