"""Files that keep arriving: taken in once each, and event counts by window with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Append the parquet files of ``source`` that were not taken in before; a second run adds nothing."""
    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, time: str, kind: str, value: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, kind, n, total) of event-time windows; on a stream, events later than ``late`` are left out and state is bounded."""
    df = events.withWatermark(time, late) if events.isStreaming else events
    w = df.groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return w.select(F.col("w.start").alias("start"), kind, "n", "total")


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "event_type", "value")


QUERIES = {"event_windows": event_windows}
SQL = {"event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"}
