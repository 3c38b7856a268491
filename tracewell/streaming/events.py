"""Streams: progress events, deduplicated events, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROGRESS_SCHEMA = "ts double, phase string, parent_phase string, status string, duration_ms long"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress lines as they are appended to files of a folder."""
    return spark.readStream.schema(PROGRESS_SCHEMA).json(path).withColumn("at", F.timestamp_seconds("ts"))


def phase_durations(progress: DataFrame) -> DataFrame:
    """Ended phases with their durations; works on a stream in update mode and on a table."""
    return progress.where("status != 'started'").groupBy("phase", "status").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"))


def distinct_events(events: DataFrame, key: str = "event_id", time: str = "at", delay: str = "10 minutes") -> DataFrame:
    """Each event once, repeats within the delay dropped; state is bounded by the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, user: str = "user_id", time: str = "at", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events and value of each user's sessions, which a gap ends."""
    return (
        events.withWatermark(time, delay)
        .groupBy(F.session_window(time, gap), user)
        .agg(F.count("*").alias("n_events"), F.sum("value").alias("value"))
        .select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events", "value")
    )


def find_new(findings: DataFrame, seen: DataFrame, key: str = "finding_id") -> DataFrame:
    """Findings of a micro-batch that the table of seen ones lacks."""
    return findings.join(seen.select(key), key, "left_anti")
