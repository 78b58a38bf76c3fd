"""Queries on scan_log: periods, gaps and log entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.functions.times import iso_ms
from codequarry.operators import intervals, logparse
from codequarry.tables import read


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the scan periods of each repository. Scans without repo_id belong to none."""
    scans = read(spark, sf_dir, "scan_log", "repo_id", "started_at", "finished_at")
    found = intervals.gaps(scans, F.col("repo_id"), iso_ms(F.col("started_at")), iso_ms(F.col("finished_at")))
    return found.withColumnRenamed("entity", "repo_id")


def p1_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous scan periods of each repository."""
    scans = read(spark, sf_dir, "scan_log", "repo_id", "started_at", "finished_at")
    found = intervals.periods(scans, F.col("repo_id"), iso_ms(F.col("started_at")), iso_ms(F.col("finished_at")))
    return found.withColumnRenamed("entity", "repo_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every scan's log, without their message texts."""
    scans = read(spark, sf_dir, "scan_log", "id", "started_at", "finished_at", "logs")
    return logparse.entries(scans).select("scan_id", "entry_no", "ts_ms", "log_level", "component", "n_lines")


def p4_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every scan's log with layout and message."""
    return logparse.entries(read(spark, sf_dir, "scan_log", "id", "started_at", "finished_at", "logs"))


_MS = "CAST(epoch_ms(CAST(CASE WHEN regexp_matches({0}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') THEN {0} ELSE {0} || 'Z' END AS TIMESTAMPTZ)) AS BIGINT)"
_ISLANDS = f"""
WITH s AS (SELECT DISTINCT repo_id, {_MS.format("started_at")} AS a, {_MS.format("finished_at")} AS b FROM scan_log
           WHERE repo_id IS NOT NULL AND started_at IS NOT NULL AND finished_at IS NOT NULL),
m AS (SELECT repo_id, a, b, max(b) OVER (PARTITION BY repo_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
      FROM s WHERE a < b)
"""
SQL = {
    "p1_found": _ISLANDS + "SELECT repo_id, reach AS gap_start_ms, a AS gap_end_ms FROM m WHERE a > reach",
    "p1_periods": _ISLANDS + """, g AS (SELECT *, sum(CASE WHEN a > reach OR reach IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY repo_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
        SELECT repo_id, min(a) AS period_start_ms, max(b) AS period_end_ms FROM g GROUP BY repo_id, island""",
}


def p4_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one layout, whose lines begin with time=, and their levels, by scan."""
    e = logparse.entries(read(spark, sf_dir, "scan_log", "id", "started_at", "finished_at", "logs")).where("layout = 'logfmt'")
    return e.groupBy("scan_id", "log_level").agg(F.count("*").alias("n"))


_ONE = f"(SELECT id, logs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY finished_at IS NOT NULL DESC, length(logs) DESC, {_MS.format('started_at')} DESC NULLS LAST, logs DESC) AS k FROM scan_log WHERE logs <> '') WHERE k = 1)"
SQL["p4_logfmt"] = f"""SELECT scan_id, CASE l WHEN 'warning' THEN 'WARN' WHEN 'warn' THEN 'WARN' WHEN 'err' THEN 'ERROR' WHEN 'crit' THEN 'FATAL' WHEN 'critical' THEN 'FATAL' WHEN 'fatal' THEN 'FATAL' ELSE upper(l) END AS log_level, count(*) AS n
    FROM (SELECT id AS scan_id, lower(regexp_extract(line, 'level=(\\w+)', 1)) AS l FROM (SELECT id, regexp_replace(unnest(regexp_split_to_array(logs, '\\r\\n|\\n|\\r')), '\\x1b\\[[0-9;]*m', '', 'g') AS line FROM {_ONE}) WHERE regexp_matches(line, '^time=[0-9]{{4}}-')) GROUP BY ALL"""
QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p4_found": p4_found, "p4_entries": p4_entries, "p4_logfmt": p4_logfmt}
