"""Clusters of events in time, the twin of clusters of intervals on a chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.session import table
from strandloom.streaming import ingest

MINUTES = 30


def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ingest.sessions(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp")), "user_id", "ts", f"{MINUTES} minutes")
    return found.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


QUERIES = (session_clusters,)

ORACLES = {
    "session_clusters": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS t FROM events WHERE ts IS NOT NULL), g AS (SELECT *, CASE WHEN t - lag(t) OVER w <= {MINUTES * 60_000_000} THEN 0 ELSE 1 END AS nw FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(t) AS start_us, max(t) + {MINUTES * 60_000_000} AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
