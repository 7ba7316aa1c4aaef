"""Streams with a ledger over kills, restarts and lost checkpoints; quarantine; stored retention; sketches."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, movement
from fleetlens.sources import telemetry
from fleetlens.streaming import ledger

START = dt.datetime(2024, 1, 1)
DDL = "id int, ts timestamp"


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture
def source(spark, tmp_path):
    """Lands one file and gives the stream over all files so far, one file a batch."""
    def add(rows, ddl):
        path = str(tmp_path / "in")
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)
    return add


def ids(spark, path, schema):
    return sorted(r.id for r in ledger.read_keyed(spark, path, schema).collect())


def test_a_kill_between_write_and_entry(spark, source, tmp_path, monkeypatch):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    stream = source([(1, at(0)), (2, at(1)), (2, at(1))], DDL)
    ledger.land_keyed(stream, table, checkpoint, ["id"])
    stream = source([(3, at(2)), (4, at(3))], DDL)
    enter = ledger.enter

    def killed(*args):
        raise RuntimeError("killed")
    monkeypatch.setattr(ledger, "enter", killed)
    with pytest.raises(Exception, match="killed"):
        ledger.land_keyed(stream, table, checkpoint, ["id"])
    # Written, but not visible.
    assert glob.glob(f"{table}/rows/generation=*/batch=1/*.parquet") and ids(spark, table, stream.schema) == [1, 2]
    monkeypatch.setattr(ledger, "enter", enter)
    for _ in range(2):
        ledger.land_keyed(stream, table, checkpoint, ["id"])
        assert ids(spark, table, stream.schema) == [1, 2, 3, 4]


def test_a_lost_checkpoint(spark, source, tmp_path):
    table = str(tmp_path / "table")
    stream = source([(1, at(0)), (None, at(0))], DDL)
    stream = source([(2, at(1))], DDL)
    ledger.land_keyed(stream, table, str(tmp_path / "first"), ["id"])
    stream = source([(3, at(2))], DDL)
    # The checkpoint is gone and all files come anew, in other batches.
    again = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
    ledger.land_keyed(again, table, str(tmp_path / "second"), ["id"])
    rows = [r.id for r in ledger.read_keyed(spark, table, stream.schema).collect()]
    assert sorted(rows, key=str) == [1, 2, 3, None]
    assert ledger.ledger(spark, table).select("generation").distinct().count() == 2


def test_late_and_counted_are_the_input(spark, source, tmp_path):
    ddl = "metric string, ts timestamp, value double"
    files = [[("cpu", at(5), 10.0), ("cpu", at(50), 20.0), ("mem", at(70), None)],
             [("cpu", at(20), 30.0), ("cpu", at(300), 1.0), ("cpu", None, 5.0)],
             [("cpu", at(10), 999.0), ("cpu", at(299), 3.0), ("mem", at(500), 1.0)],
             [("mem", at(400), 2.0), ("cpu", at(2000), 1.0)]]
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for rows in files:
        stream = source(rows, ddl)
        ledger.land_hourly(stream, table, checkpoint, "30 minutes")
    late = {(r.metric, r.ts, r.value) for r in ledger.read_late(spark, table, stream.schema).collect()}
    assert late == {("cpu", None, 5.0), ("cpu", at(10), 999.0), ("mem", at(400), 2.0)}
    entries = ledger.ledger(spark, table).collect()
    assert sum(r.batch_rows for r in entries) == sum(map(len, files)) and sum(r.late_rows for r in entries) == len(late)
    every = ledger.read_windows(spark, table, "metric string, total double, points long", ["metric"], ["total", "points"], "30 minutes", closed=False)
    assert {(r.metric, r.window_start): (r.total, r.points) for r in every.collect()} == {
        ("cpu", at(0)): (60.0, 3), ("mem", at(60)): (None, 0), ("cpu", at(300)): (1.0, 1), ("cpu", at(240)): (3.0, 1),
        ("mem", at(480)): (1.0, 1), ("cpu", at(1980)): (1.0, 1)}
    closed = {(r.metric, r.window_start): r.average for r in ledger.read_hourly(spark, table, "30 minutes", {"metric": "string"}).collect()}
    assert ("cpu", at(1980)) not in closed and closed["cpu", at(0)] == 20.0


def test_late_log_errors(spark, source, tmp_path):
    def line(minute, level="ERROR"):
        return ("log", f"[{at(minute):%Y-%m-%d %H:%M:%S}] [{level}] x")
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    for rows in ([line(1), line(2, "INFO"), line(3)], [line(200)], [line(4), line(201), line(400)]):
        ledger.land_log_errors(source(rows, "path string, value string"), table, checkpoint, "10 minutes")
    assert {r.window_start: r.errors for r in ledger.read_log_errors(spark, table, "10 minutes").collect()} == {at(0): 2, at(180): 2}
    assert sum(r.late_rows for r in ledger.ledger(spark, table).collect()) == 1


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_quarantine(spark, tmp_path, fmt):
    lines = {"json": ['{"a": 1, "b": "x"}', '{"a": 2, "b"', '{"a": "word", "b": "y"}', '{"b": "z"}', ''],
             "csv": ["1,x", "2", "word,y", ",z", "3,x,more"]}[fmt]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    good, bad = telemetry.read_quarantined(spark, str(tmp_path / "in.txt"), fmt=fmt, schema="a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x"), (None, "z")]
    assert sorted(r.record for r in bad.collect()) == sorted([lines[1], lines[2]] + ([lines[4]] if fmt == "csv" else []))
    assert all(r.path.endswith("in.txt") for r in bad.collect())


def test_whole_days_are_not_opened(spark, tmp_path):
    path = str(tmp_path / "series")
    names = ["old / odd+name", "b", "free"]
    points = spark.range(10 * 24 * 3).select(
        F.element_at(F.array(*map(F.lit, names)), (F.col("id") % 3 + 1).cast("int")).alias("measurement"),
        (F.lit(START).cast("timestamp") + F.make_dt_interval(hours=F.floor(F.col("id") / 3).cast("int"))).alias("ts"), "id")
    points = points.unionByName(spark.createDataFrame([("b", None, -1)], points.schema.simpleString()[7:-1].replace(":", " ")))
    movement.write_by_day(points, path)
    policies = spark.createDataFrame([(names[0], 3), ("b", 5)], "measurement string, days int")
    as_of = dt.datetime(2024, 1, 10, 12)
    expected = sorted(r.id for r in points.collect() if r.ts is None or r.measurement == "free"
                      or r.ts >= as_of - dt.timedelta(days={names[0]: 3, "b": 5}[r.measurement]))
    actions = movement.retention_actions(spark, path, policies, as_of)
    straddling = {r.folder for r in actions.filter("action = 'rewrite'").collect()}
    assert len(straddling) == 2
    # Files of whole days hold nothing that could be read.
    kept = {}
    for name in glob.glob(f"{path}/**/*.parquet", recursive=True):
        if not any(name.startswith(folder.removeprefix("file:")) for folder in straddling):
            kept[name] = open(name, "rb").read()
            open(name, "wb").write(b"not parquet")
    done = movement.enforce_stored_retention(spark, path, policies, as_of, schema=points.schema)
    assert {r.action: r.n for r in done.groupBy("action").agg(F.count("*").alias("n")).collect()} == {"drop": 6 + 4, "rewrite": 2, "keep": 10 + 1 + 3 + 5}
    for name, data in kept.items():
        if os.path.exists(name):
            open(name, "wb").write(data)
    spark.catalog.refreshByPath(path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == expected
    # A second run finds nothing more to do.
    movement.enforce_stored_retention(spark, path, policies, as_of)
    spark.catalog.refreshByPath(path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == expected


def test_a_straddling_day_without_young_points_goes(spark, tmp_path):
    path = str(tmp_path / "series")
    movement.write_by_day(spark.createDataFrame([("a", at(60), 1), ("a", at(3000), 2)], "measurement string, ts timestamp, id int"), path)
    policies = spark.createDataFrame([("a", 1)], "measurement string, days int")
    movement.enforce_stored_retention(spark, path, policies, at(24 * 60 + 600))
    assert [r.id for r in spark.read.parquet(path).collect()] == [2]


def test_sketches_merge(spark):
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("user"), F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("kind"),
                                    F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    states = aggregates.cardinality_states(df, ["user", "kind"])
    exact = df.select("user", "kind").distinct().count()
    guess = aggregates.cardinality_rollup(states).first().series
    assert abs(guess - exact) <= 0.05 * exact
    assert states.agg(F.max(F.length("state"))).first()[0] <= (1 << 12) + 100
    daily = aggregates.cardinality_rollup(states, unit="day").collect()
    assert len(daily) == 42 and all(abs(r.series - 1440) <= 72 for r in daily[:-1] if r.span != max(d.span for d in daily))


@pytest.mark.parametrize("tracked, certain", [(200, True), (5000, True), (20, False)])
def test_frequent_patterns(spark, tracked, certain):
    """Twenty heavy prefixes among thousands that come once."""
    heavy = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("h"), F.floor(F.sqrt(F.col("id") % 400)).cast("int"), F.lit(":"), "id"))
                                       .otherwise(F.concat(F.lit("once"), "id", F.lit("_x"))).alias("key"), F.col("id").alias("bytes"))
    keys = heavy.unionByName(spark.range(3000).select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("long").alias("bytes")))
    got = aggregates.frequent_patterns(keys, top=10, tracked=tracked)
    rows = got.collect()
    assert all(r.certain == certain for r in rows)
    if certain:
        exact = aggregates.key_patterns(keys.withColumn("type", F.lit("t"))).orderBy(F.desc("count"), "pattern").limit(10)
        assert sorted(map(str, got.drop("error_bound", "certain").collect())) == sorted(map(str, exact.select(*got.drop("error_bound", "certain").columns).collect()))
    assert aggregates.frequent_patterns(keys.limit(0)).collect() == []
