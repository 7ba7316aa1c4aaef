"""Streaming operators: a stream in, a stream out. All that keep state need a watermark."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import names
from ..operators.aggregates import hourly_points
from ..operators.rules import Rule, apply_rules
from ..sources.logs import parse_logs


def watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp (watermarks need one) with a bound on lateness."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def stream_hourly_metrics(stream: DataFrame, watermark: str, keys: Iterable[str] = ("metric",), ts: str = "ts",
                          value: str = "value", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Averages per key and window, each sent once when its window is closed."""
    return hourly_points(watermarked(stream, ts, watermark), keys, ts, value, width, slide)


def stream_alerts(stream: DataFrame, rules: Sequence[Rule], keys: Iterable[str]) -> DataFrame:
    """Findings as metrics arrive; keeps no state."""
    return apply_rules(stream, rules, keys)


def stream_log_errors(lines: DataFrame, watermark: str, width: str = "1 hour", source: str = "path") -> DataFrame:
    """Error lines per log and window."""
    errors = parse_logs(lines, source).filter(F.col("level") == "ERROR")
    counts = errors.withWatermark("ts", watermark).groupBy("source", F.window("ts", width).alias("w")).agg(
        F.count("*").alias("errors"))
    return counts.select("source", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "errors")


def stream_reports(stream: DataFrame, keys: Sequence[str], watermark: str, ts: str = "ts") -> DataFrame:
    """Report rows without the repeats that a retried sender produces."""
    return watermarked(stream, ts, watermark).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(stream: DataFrame, gap: str, watermark: str, keys: Iterable[str], ts: str = "ts") -> DataFrame:
    """Activity sessions per client: a pause longer than the gap ends one."""
    sessions = watermarked(stream, ts, watermark).groupBy(
        *names(keys), F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("events"))
    return sessions.select(*names(keys), F.col("s.start").alias("session_start"),
                           F.col("s.end").alias("session_end"), "events")
