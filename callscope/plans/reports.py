"""Queries over reports, quality gates and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callscope.plans.registry import query
from callscope.streaming import windows


@query("str02_windowed_counts", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def str02_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly counts, the batch form of the streaming query."""
    return windows.hourly(spark.read.parquet(f"{sf_dir}/events.parquet"))


@query("str02_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minute THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def str02_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions with a gap of 30 minutes."""
    return windows.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))
