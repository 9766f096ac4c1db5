"""Vertex tables as they land in a folder: an extra beside the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COORDS = ("x", "y", "z")


def watch_vertices(spark: SparkSession, folder: str, schema: str, max_files: int = 100) -> DataFrame:
    """A stream of the Parquet vertex tables that arrive in ``folder``, so many files a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def running_boxes(vertices: DataFrame, keys: tuple[str, ...] = ("uid",), coords: tuple[str, ...] = COORDS) -> DataFrame:
    """Count and box of every cloud so far; the state is one row for each cloud."""
    ends = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in coords for n, f in (("min", F.min), ("max", F.max))]
    return vertices.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), *ends)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window; rows later than the watermark are left out and closed windows are let go."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", key, "n")
