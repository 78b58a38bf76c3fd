"""Queries that run as streams over the tables up to now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.streaming import incremental


def _events(spark, d):
    return incremental.stream(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type, from a stream."""
    got = incremental.run(incremental.window_counts(_events(spark, d)), "complete")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", F.round("value", 2).alias("value"))


def stream_sliding_day(spark: SparkSession, d: str) -> DataFrame:
    """Events in windows of a day that begin every six hours, from a stream."""
    got = incremental.run(incremental.window_counts(_events(spark, d), "24 hours", "6 hours"), "complete")
    return got.select(F.date_format("w.start", "yyyy-MM-dd HH").alias("start"), "event_type", "n")


def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits of users by gaps of 30 minutes, from a stream."""
    got = incremental.run(incremental.gap_windows(_events(spark, d)), "complete")
    return got.groupBy("user_id").agg(F.count("*").alias("n_visits"), F.sum("n").alias("n"))


def stream_latest_scans(spark: SparkSession, d: str) -> DataFrame:
    """Scans by id, the finished form winning, by upserts of a stream."""
    scans = incremental.stream(spark, f"{d}/scan_log.parquet").select("id", "repo_id", "status", "finished_at")
    return incremental.latest(scans, ["id"], "finished_at").select("id", "repo_id", "status")


def stream_head_moves(spark: SparkSession, d: str) -> DataFrame:
    """Scans as moves of a head: every repository's first type of scan is full, a change of type is a move."""
    scans = incremental.stream(spark, f"{d}/scan_log.parquet", 1000).where("repo_id is not null and finished_at is not null")
    heads = scans.select("repo_id", iso_ms(F.col("started_at")).alias("ms"), F.concat_ws("-", "scan_type", "exit_code").alias("head"))
    got = incremental.run(incremental.head_moves(heads))
    return got.groupBy("repo_id", "scan_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_sliding_day, stream_visits, stream_latest_scans, stream_head_moves)}
_MS = "CAST(epoch_ms(CAST(CASE WHEN regexp_matches(started_at, '(Z|[+-][0-9]{2}:[0-9]{2})$') THEN started_at ELSE started_at || 'Z' END AS TIMESTAMPTZ)) AS BIGINT)"
SQL = {
    "stream_event_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL",
    "stream_sliding_day": "SELECT strftime(w, '%Y-%m-%d %H') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOURS * k for k in [0, 1, 2, 3]]) AS w FROM events) GROUP BY ALL",
    "stream_visits": "SELECT user_id, count(*) FILTER (prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 1800000000) AS n_visits, count(*) AS n FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id",
    "stream_latest_scans": "SELECT DISTINCT id, repo_id, status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at DESC NULLS LAST) AS k FROM scan_log) WHERE k = 1",
    "stream_head_moves": f"SELECT repo_id, CASE WHEN prev IS NULL THEN 'full' ELSE 'incremental' END AS scan_type, count(*) AS n FROM (SELECT *, lag(head) OVER (PARTITION BY repo_id ORDER BY ms, head) AS prev FROM (SELECT repo_id, {_MS} AS ms, concat_ws('-', scan_type, exit_code) AS head FROM scan_log WHERE repo_id IS NOT NULL AND finished_at IS NOT NULL)) WHERE prev IS NULL OR prev <> head GROUP BY ALL",
}
