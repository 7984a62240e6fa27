"""The engine's aggregates over event streams: windows with a watermark, and distinct rows within it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import aggregate


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files that appear under a path (a glob is fine) as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(events: DataFrame, time: str, window: str, delay: str, key: list[str], aggs: dict[str, tuple[str, str | None]], slide: str | None = None) -> DataFrame:
    """Aggregates (out: (func, col)) by key and time window; rows later than delay behind the newest are dropped."""
    types = {f.name: f.dataType for f in events.schema}
    made: list[Column] = [aggregate(f, None if c is None else F.col(c), types.get(c)).alias(out) for out, (f, c) in aggs.items()]
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, delay).groupBy(w.alias("window"), *key).agg(*made).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *key, *aggs)


def sessions(events: DataFrame, time: str, gap: str, delay: str, key: list[str]) -> DataFrame:
    """Rows by key and session: a session ends after a gap without rows."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, delay).groupBy(w.alias("session"), *key).agg(F.count(F.lit(1)).alias("n")).select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *key, "n")


def distinct(events: DataFrame, time: str, delay: str, key: list[str]) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def drained(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a streaming result over what is there now, appends its closed windows to path, and reads that."""
    q = result.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)
