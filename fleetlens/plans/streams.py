"""Streams over the driver tables, run on what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators.rules import Rule
from ..streaming import jobs, ledger, operators as op
from ..streaming.run import land_available
from ..workspace import new_dir
from .registry import plan
from .shapes import money
from .sources import log_lines


def event_stream(t):
    # A glob, because the plain path of a stream must be a folder.
    return t.spark.readStream.schema(t.events.schema).parquet(t.path("event[s]"))


def plain_times(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@plan("s01_stream_hourly_metrics", """
SELECT event_type AS metric, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
FROM events GROUP BY 1, 2, 3 HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def stream_hourly_metrics(t):
    points = event_stream(t).select(F.col("event_type").alias("metric"), "ts", money("value").alias("value"))
    return plain_times(land_available(op.stream_hourly_metrics(points, "2 hours"), "hourly"), "window_start", "window_end")


@plan("s01_stream_sliding_metrics", """
WITH w AS (SELECT event_type AS metric, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start, value FROM events)
SELECT metric, window_start, window_start + INTERVAL 2 HOUR AS window_end, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
FROM w GROUP BY ALL HAVING window_end <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def stream_sliding_metrics(t):
    points = event_stream(t).select(F.col("event_type").alias("metric"), "ts", money("value").alias("value"))
    averages = op.stream_hourly_metrics(points, "2 hours", width="2 hours", slide="1 hour")
    return plain_times(land_available(averages, "sliding"), "window_start", "window_end")


# Files in the order of their weeks, but every seventh row comes a day and a half too late.
LATE_SQL = """
l AS (SELECT event_type AS metric, event_id, ts, value, CAST(date_trunc('week', ts + INTERVAL 36 HOUR * CAST(event_id % 7 = 0 AS INTEGER)) AS DATE) AS week FROM events),
n AS (SELECT week, max(ts) AS newest FROM l GROUP BY week),
m AS (SELECT week, max(newest) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM n),
r AS (SELECT l.*, coalesce(date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark, false) AS late FROM l JOIN m USING (week))
"""


def belated_events(t):
    """Events landed as one file a week, read one file a batch."""
    path = new_dir(t.spark, "belated")
    arrived = F.col("ts") + F.when(F.col("event_id") % 7 == 0, F.expr("INTERVAL 36 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    rows = t.events.select(F.col("event_type").alias("metric"), "event_id", "ts", money("value").alias("value"), F.to_date(F.date_trunc("week", arrived)).alias("week"))
    # Written one after the other, as a stream reads files by their age.
    for row in rows.select("week").distinct().orderBy("week").toLocalIterator():
        rows.filter(F.col("week") == row.week).coalesce(1).write.mode("append").parquet(path)
    return rows.schema, t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def landed_hours(t):
    root = new_dir(t.spark, "late")
    schema, stream = belated_events(t)
    ledger.land_hourly(stream, f"{root}/table", f"{root}/checkpoint", "2 hours")
    return f"{root}/table", schema


@plan("s01_late_rows", f"WITH {LATE_SQL} SELECT metric, event_id, ts FROM r WHERE late")
def late_rows(t):
    path, schema = landed_hours(t)
    return ledger.read_late(t.spark, path, schema).select("metric", "event_id", "ts")


@plan("s01_counted_in_time", f"""
WITH {LATE_SQL}
SELECT metric, date_trunc('hour', ts) AS window_start, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
FROM r WHERE NOT late GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR
""")
def counted_in_time(t):
    path, _ = landed_hours(t)
    hours = ledger.read_hourly(t.spark, path, "2 hours", {"metric": "string"}, "decimal(22,2)")
    return plain_times(hours, "window_start").select("metric", "window_start", "average")


@plan("s02_stream_alerts", """
SELECT event_id, CASE WHEN value > 200 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Value' AS category, event_type AS message, 'Look at it' AS recommendation
FROM events WHERE value > 80
UNION ALL SELECT event_id, 'INFO', 'Errors', 'error of ' || user_id, 'Look at it' FROM events WHERE event_type = 'error'
""")
def stream_alerts(t):
    value = F.col("value")
    rules = [
        Rule(value > 200, "CRITICAL", "Value", F.col("event_type"), "Look at it", "value"),
        Rule(value > 80, "WARNING", "Value", F.col("event_type"), "Look at it", "value"),
        Rule(F.col("event_type") == "error", "INFO", "Errors", F.concat(F.lit("error of "), "user_id"), "Look at it"),
    ]
    return land_available(op.stream_alerts(event_stream(t), rules, ["event_id"]), "alerts")


@plan("s03_stream_job_status", """
WITH j AS (SELECT user_id AS job_id, min(ts) AS started, min(ts) FILTER (event_type IN ('purchase', 'error')) AS ended,
             arg_min(event_type, ts) FILTER (event_type IN ('purchase', 'error')) AS how FROM events GROUP BY user_id),
 s AS (SELECT *, ended IS NOT NULL AND ended - started <= INTERVAL 12 HOUR AS intime FROM j)
SELECT job_id, started, CASE WHEN intime THEN ended END AS ended, CASE WHEN intime THEN CASE how WHEN 'purchase' THEN 'success' ELSE 'failed' END ELSE 'timeout' END AS status
FROM s WHERE ended IS NOT NULL OR started + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_job_status(t):
    events = event_stream(t).select(
        F.col("user_id").alias("job_id"), "ts",
        bands.decode("event_type", {"purchase": "SUCCESS", "error": "FAILED"}, "IN_PROGRESS").alias("state"))
    return plain_times(land_available(jobs.stream_job_status(events, 12 * 3600.0, "1 hour"), "jobs"), "started", "ended")


@plan("s04_stream_log_errors", """
SELECT strftime(ts, 'day%Y%m%d') AS source, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, count(*) AS errors
FROM events WHERE event_type = 'error' AND hour(ts) < 15 GROUP BY 1, 2, 3
HAVING window_end <= (SELECT max(date_trunc('second', ts)) FROM events WHERE event_type = 'error' AND hour(ts) < 15) - INTERVAL 1 HOUR
""")
def stream_log_errors(t):
    path = new_dir(t.spark, "logs")
    log_lines(t).withColumnRenamed("path", "log").write.partitionBy("log").text(path)
    lines = t.spark.readStream.schema("value string, log string").text(path).withColumnRenamed("log", "path")
    return plain_times(land_available(op.stream_log_errors(lines, "1 hour"), "log-errors"), "window_start", "window_end")


@plan("s05_stream_reports", "SELECT event_id, ts, event_type FROM events")
def stream_reports(t):
    rows = event_stream(t).select("event_id", "ts", "event_type")
    repeated = rows.unionByName(event_stream(t).select("event_id", "ts", "event_type"))
    return plain_times(land_available(op.stream_reports(repeated, ["event_id"], "1 hour"), "deduplicated"), "ts")


@plan("s05_ledgered_reports", "SELECT event_id, ts, event_type FROM events")
def ledgered_reports(t):
    """A stream that lost its checkpoint and read everything again, into the table it had begun."""
    root, rows = new_dir(t.spark, "ledgered"), event_stream(t).select("event_id", "ts", "event_type")
    ledger.land_keyed(rows.filter("event_id % 3 > 0"), f"{root}/table", f"{root}/first", ["event_id"])
    ledger.land_keyed(rows, f"{root}/table", f"{root}/second", ["event_id"])
    return ledger.read_keyed(t.spark, f"{root}/table", rows.schema)


@plan("s06_stream_sessions", """
WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 n AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM f)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS events FROM n GROUP BY user_id, s
HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def stream_sessions(t):
    sessions = op.stream_sessions(event_stream(t), "6 hours", "1 hour", ["user_id"])
    return plain_times(land_available(sessions, "sessions"), "session_start", "session_end")
