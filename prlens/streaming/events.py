"""An extension for streams: windowed counts with a watermark. The same aggregation runs on a batch table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of new Parquet files in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by kind and tumbling window; on a stream, rows later than ``late`` are dropped."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("_ts", late)
    out = e.groupBy(F.window("_ts", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), kind, "n", "total")
