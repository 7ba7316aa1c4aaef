"""Streams fed in several batches equal the batch operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.rules import Rule
from fleetlens.streaming import jobs, operators, run

START = dt.datetime(2024, 1, 1)


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def feed(spark, tmp_path):
    """Runs a stream operator over batches landed one after the other, restarting it each time."""
    def go(ddl, batches, operator):
        source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
        for batch in batches:
            spark.createDataFrame(batch, ddl).coalesce(1).write.mode("append").parquet(source)
            stream = operator(spark.readStream.schema(ddl).parquet(source))
            run.land(stream, target, checkpoint)
        return spark.read.schema(stream.schema).parquet(target)
    return go


def test_hourly_metrics_close_windows_once(feed, rows):
    batches = [[("cpu", at(5), 10.0), ("cpu", at(50), 20.0)], [("cpu", at(20), 30.0), ("cpu", at(200), 1.0)],
               [("cpu", at(10), 999.0), ("cpu", at(500), 1.0)]]  # the last one is too late for its window
    got = feed("metric string, ts timestamp, value double", batches,
               lambda s: operators.stream_hourly_metrics(s, "30 minutes"))
    assert rows(got, "metric", "window_start", "average") == [("cpu", at(0), 20.0), ("cpu", at(180), 1.0)]


def test_alerts_keep_no_state(feed, rows):
    rule = Rule(F.col("value") > 80, "WARNING", "cpu", "high", "look")
    got = feed("id int, value double", [[(1, 90.0), (2, 10.0)], [(3, 81.0)]],
               lambda s: operators.stream_alerts(s, [rule], ["id"]))
    assert rows(got, "id", "severity") == [(1, "WARNING"), (3, "WARNING")]


def test_repeats_across_batches_are_dropped(feed, rows):
    got = feed("id int, ts timestamp", [[(1, at(0)), (1, at(0)), (2, at(1))], [(2, at(1)), (3, at(2))]],
               lambda s: operators.stream_reports(s, ["id"], "1 hour"))
    assert rows(got, "id") == [(1,), (2,), (3,)]


def test_sessions_span_batches(feed, rows):
    got = feed("client string, ts timestamp", [[("a", at(0)), ("a", at(4))], [("a", at(8)), ("a", at(30))], [("b", at(300))]],
               lambda s: operators.stream_sessions(s, "5 minutes", "1 minute", ["client"]))
    assert rows(got, "client", "session_start", "session_end", "events") == [
        ("a", at(0), at(13), 3), ("a", at(30), at(35), 1)]


def test_log_errors_per_window(feed, rows):
    line = lambda m, level: f"[{at(m):%Y-%m-%d %H:%M:%S}] [{level}] x"
    batches = [[("log", line(1, "ERROR")), ("log", line(2, "INFO")), ("log", line(3, "ERROR"))], [("log", line(200, "ERROR"))]]
    got = feed("path string, value string", batches, lambda s: operators.stream_log_errors(s, "10 minutes"))
    assert rows(got, "source", "errors") == [("log", 2)]


def test_jobs_end_once_or_time_out(feed, rows):
    batches = [
        [(1, at(0), "STARTED"), (2, at(0), "STARTED"), (3, at(0), "STARTED"), (4, at(0), "STARTED")],
        [(1, at(10), "SUCCESS"), (1, at(11), "FAILED"), (2, at(12), "FAILED"), (4, at(70), "SUCCESS")],
        [(1, at(20), "SUCCESS"), (9, at(300), "STARTED")],
        [(9, at(301), "SUCCESS")]]
    got = feed("job_id long, ts timestamp, state string", batches,
               lambda s: jobs.stream_job_status(s, 3600.0, "5 minutes"))
    assert rows(got, "job_id", "started", "ended", "status") == [
        (1, at(0), at(10), "success"), (2, at(0), at(12), "failed"), (3, at(0), None, "timeout"),
        (4, at(0), None, "timeout"), (9, at(300), at(301), "success")]


@pytest.mark.parametrize("cut", [1, 3, 4])
def test_job_is_sent_once_however_it_is_batched(feed, rows, cut):
    events = [("late", at(0), "RUNNING"), ("other", at(209), "SUCCESS"), ("late", at(210), "RUNNING"), ("late", at(215), "SUCCESS")]
    batches = [events[i:i + cut] for i in range(0, len(events), cut)] + [[("clock", at(n), "SUCCESS")] for n in (400, 500)]
    got = feed("job_id string, ts timestamp, state string", batches, lambda s: jobs.stream_job_status(s, 3600, "1 minute"))
    assert rows(got.filter("job_id in ('late', 'other')"), "job_id", "started", "status") == [
        ("late", at(0), "timeout"), ("other", at(209), "success")]
