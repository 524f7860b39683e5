"""Windows over event time, the same for tables and streams. Extensions: the survey's reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    # Watermarks need a timestamp with a time zone.
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming else events


def hourly(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Counts and sums by hour and type; a stream drops what comes later than ``delay``."""
    out = _late(events, delay).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "2 hours") -> DataFrame:
    """Sessions of a user, ended by ``gap`` without events."""
    out = _late(events, delay).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, body) of text files as they arrive below ``path``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").schema("value string").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def first_seen(hosts: DataFrame, forget: str = "30 days") -> DataFrame:
    """(repo, host) the first time a repository names a host. ``hosts``: a stream of (repo, host, ts).

    A pair leaves the state once event time is ``forget`` past the row that brought it, and counts as
    new when it comes again; so the state holds what was named lately and not all that ever was.
    """
    return _late(hosts, forget).dropDuplicatesWithinWatermark(["repo", "host"]).select("repo", "host")
