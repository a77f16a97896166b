"""Streaming twins: alignment statistics while reads arrive, and sessions of positions in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_arrivals(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """A stream over parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def type_counts(arrivals: DataFrame, watermark: str = "28 days") -> DataFrame:
    """(run_day, read_type, reads, bases) of reads, each counted once while within the watermark of its load time."""
    once = arrivals.withWatermark("load_ts", watermark).dropDuplicatesWithinWatermark(["qname"])
    return once.groupBy("run_day", "read_type").agg(F.count("*").alias("reads"), F.sum("qlen").alias("bases"))


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """(key, session_start, session_end, n): runs of events with pauses below ``gap``; works on batches and streams."""
    rows = events.withWatermark(ts, watermark) if watermark else events
    grouped = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def islands_in_time(events: DataFrame, key: str, ts: str, minutes: int) -> DataFrame:
    """The same by gaps and islands, for batches: (key, session_start, last_event, n)."""
    w = Window.partitionBy(key).orderBy(ts)
    pause = F.unix_micros(ts) - F.unix_micros(F.lag(ts).over(w))
    numbered = events.withColumn("_new", F.when(pause < minutes * 60_000_000, 0).otherwise(1)).withColumn("_session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "_session").agg(F.min(ts).alias("session_start"), F.max(ts).alias("last_event"), F.count("*").alias("n")).drop("_session")
