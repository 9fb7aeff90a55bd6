"""Streams over the events table, run over all it holds and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestay.plans.registry import load, query
from lodestay.storage import kept_path
from lodestay.streaming import feeds


def _drained(spark: SparkSession, result: DataFrame, mode: str) -> DataFrame:
    folder = kept_path(spark, "stream")
    return feeds.drain(result, f"{folder}/rows", f"{folder}/state", mode)


@query("stream_quota", "SELECT (ts - INTERVAL 10 HOUR)::DATE::VARCHAR AS quota_day, event_type AS model, count(*) AS calls FROM events GROUP BY 1, 2")
def stream_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, feeds.quota_counts(feeds.table_stream(spark, sf_dir, "events"), "ts", "event_type"), "complete")


@query("stream_first_sightings", "SELECT DISTINCT user_id, event_type FROM events")
def stream_first_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watermark spans all of the month that the table covers."""
    rows = feeds.table_stream(spark, sf_dir, "events")
    return _drained(spark, feeds.first_sightings(rows, ["user_id", "event_type"], "ts", "60 days").select("user_id", "event_type"), "append")


@query(
    "stream_sessions",
    """WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
       g AS (SELECT user_id, ts, count(*) FILTER (WHERE before IS NULL OR ts >= before + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l)
       SELECT user_id, min(ts) AS start_ts, count(*) AS n FROM g GROUP BY user_id, s""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _drained(spark, feeds.sessions(feeds.table_stream(spark, sf_dir, "events"), "user_id", "ts"), "complete")
    return found.withColumn("start_ts", F.col("start_ts").cast(load(spark, sf_dir, "events").schema["ts"].dataType))
