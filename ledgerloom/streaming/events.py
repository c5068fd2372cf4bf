"""Events as a stream: watermarked windows and deduplication; the same functions run on a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:  # noqa: ANN001
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need an instant; times without a zone are UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums by window and type; events later than `late` behind the newest are left out of a stream."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_seen(events: DataFrame, late: str = "2 days") -> DataFrame:
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
