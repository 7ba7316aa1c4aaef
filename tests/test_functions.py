from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import bands, numbers, sizes, text, times
from fleetlens.functions.columns import with_defaults


def one(spark, col):
    return spark.range(1).select(col.alias("v")).head()["v"]


@pytest.mark.parametrize("lag,label", [
    (None, "REPLICATION_STOPPED"), (0, "SYNCHRONIZED"), (1, "ACCEPTABLE"), (59, "ACCEPTABLE"),
    (60, "WARNING"), (299, "WARNING"), (300, "CRITICAL"), (3661, "CRITICAL")])
def test_lag_detail(spark, lag, label):
    assert one(spark, bands.band(F.lit(lag).cast("long"), bands.LAG_DETAIL, "CRITICAL", bands.LAG_STOPPED)) == label


@pytest.mark.parametrize("lag,label", [(None, "REPLICATION_STOPPED"), (0, "SYNCHRONIZED"), (59, "ACCEPTABLE_LAG"), (60, "HIGH_LAG")])
def test_lag_summary(spark, lag, label):
    assert one(spark, bands.band(F.lit(lag).cast("long"), bands.LAG_SUMMARY, "HIGH_LAG", bands.LAG_STOPPED)) == label


@pytest.mark.parametrize("value,action,priority,level", [
    (4.99, "NONE", 3, "Good"), (5.0, "REORGANIZE", 2, "Moderate"), (29.99, "REORGANIZE", 2, "Moderate"), (30.0, "REBUILD", 1, "High")])
def test_fragmentation_bands(spark, value, action, priority, level):
    v = F.lit(value)
    assert one(spark, bands.band(v, bands.FRAGMENTATION_ACTION, "NONE")) == action
    assert one(spark, bands.band(v, bands.FRAGMENTATION_PRIORITY, 3)) == priority
    assert one(spark, bands.band(v, bands.FRAGMENTATION_LEVEL, "High")) == level


def test_null_without_null_label_takes_else(spark):
    assert one(spark, bands.decode(F.lit(None).cast("string"), {"a": 1}, 9)) == 9


@pytest.mark.parametrize("n,shown", [
    (0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (1048576, "1.0 MB"), (1024 ** 3, "1.0 GB"),
    (1024 ** 4, "1.0 TB"), (1024 ** 5, "1.0 PB"), (5000 * 1024 ** 5, "5000.0 PB"), (None, None)])
def test_format_bytes(spark, n, shown):
    assert one(spark, sizes.format_bytes(F.lit(n).cast("long"))) == shown


@pytest.mark.parametrize("n,shown", [
    (0, "0B"), (1023, "1023B"), (1024, "1.0KiB"), (1025, "1.1KiB"), (1536, "1.5KiB"), (10240, "10KiB"), (10241, "11KiB"),
    (1023 * 1024, "1023KiB"), (1023 * 1024 + 1, "1.0MiB"), (1024 ** 2, "1.0MiB"), (10137, "9.9KiB"), (10189, "10KiB")])
def test_format_bytes_iec(spark, n, shown):
    assert one(spark, sizes.format_bytes(F.lit(n).cast("long"), "iec")) == shown


@pytest.mark.parametrize("value,n", [
    ("12", 12), ("12 bytes", 12), ("1.5 MB", 1572864), ("1.5MiB", 1572864), ("4.0K", 4096), ("2G", 2 * 1024 ** 3), ("0B", 0),
    ("N/A", None), ("Unknown", None), ("", None), (None, None)])
def test_parse_bytes(spark, value, n):
    assert one(spark, sizes.parse_bytes(F.lit(value).cast("string"))) == n


def test_sizes_round_trip(spark):
    df = spark.range(0, 60).select(F.pow(F.lit(2.0), "id").cast("long").alias("n"))
    back = df.select("n", sizes.parse_bytes(sizes.format_bytes("n")).alias("b"))
    assert back.filter(F.abs(F.col("n") - F.col("b")) > F.col("n") * 0.06).count() == 0


@pytest.mark.parametrize("secs,shown", [
    (None, "N/A"), (-5, "N/A"), (0, "N/A"), (1, "0h 0m 1s"), (59, "0h 0m 59s"), (60, "0h 1m 0s"), (3661, "1h 1m 1s"), (90000, "25h 0m 0s")])
def test_format_duration(spark, secs, shown):
    assert one(spark, times.format_duration(F.lit(secs).cast("long"))) == shown


def test_elapsed_counts_boundaries(spark):
    a, b = F.lit("2024-01-01 00:00:00.9").cast("timestamp"), F.lit("2024-01-01 00:00:01.1").cast("timestamp")
    assert one(spark, times.elapsed(a, b)) == 1
    a, b = F.lit("2024-01-01 00:00:59").cast("timestamp"), F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert one(spark, times.elapsed(a, b, "minute")) == 1
    assert one(spark, times.elapsed(a, b, "exact")) == 1.0


def test_parse_when(spark):
    when = dt.datetime(2024, 1, 2, 3, 4, 5)
    stamp = lambda c: c.cast("timestamp_ntz")
    assert one(spark, stamp(times.parse_when(F.lit("db_backup_20240102_030405.sql.gz"), "name"))) == when
    assert one(spark, stamp(times.parse_when(F.lit("2024-01-02T03:04:05.000Z"), "iso"))) == when
    assert one(spark, stamp(times.parse_when(F.lit(1704164645), "epoch"))) == when
    assert one(spark, times.parse_when(F.lit("no stamp"), "name")) is None
    assert one(spark, times.epoch_or_never(F.lit(0))) == "Never"


@pytest.mark.parametrize("key,prefix", [("a:b_c", "a"), ("a_b:c", "a"), ("plain", "simple"), ("user_1", "user"), ("s:1", "s")])
def test_key_prefix(spark, key, prefix):
    assert one(spark, text.key_prefix(F.lit(key))) == prefix


def test_globs(spark):
    df = spark.createDataFrame([("logs-1",), ("db_backup_x.sql.gz",), ("logs",), ("a.b",)], "name string")
    assert {r.name for r in text.match_glob(df, "name", "logs-*, db_backup_*.sql*").collect()} == {"logs-1", "db_backup_x.sql.gz"}
    assert {r.name for r in text.match_glob(df, "name", "a?b").collect()} == {"a.b"}
    assert text.match_glob(df, "name", "log").count() == 0


def test_qualified_name_is_null_when_a_part_is(spark):
    assert one(spark, text.qualified_name(F.lit("a"), F.lit("b"))) == "a.b"
    assert one(spark, text.qualified_name(F.lit("a"), F.lit(None).cast("string"))) is None


def test_packed_numbers(spark):
    assert one(spark, text.packed_numbers(F.lit("keys=3,expires=1,avg_ttl=0"))) == {"keys": 3, "expires": 1, "avg_ttl": 0}


def test_guarded_ratios(spark):
    assert one(spark, numbers.pct(F.lit(1), F.lit(0))) is None
    assert one(spark, numbers.pct(F.lit(1), F.lit(0), "zero")) == 0.0
    assert one(spark, numbers.share_of(F.lit(3), F.lit(1))) == 75.0
    assert one(spark, numbers.share_of(F.lit(0), F.lit(0))) is None
    assert one(spark, numbers.round_to(F.lit(2.5), 0, "half_even")) == 2.0
    assert one(spark, numbers.round_to(F.lit(2.5), 0)) == 3.0


def test_defaults(spark):
    df = spark.createDataFrame([(None, "x")], "a int, b string")
    assert with_defaults(df, {"a": -1, "b": "NOT_SET", "c": "Unknown"}).head().asDict() == {"a": -1, "b": "x", "c": "Unknown"}


def test_strip_affixes(spark):
    assert one(spark, text.strip_affixes(F.lit("db.orders_data.csv"), "db.", "_data.csv")) == "orders"
    assert one(spark, text.strip_affixes(F.lit("orders"), "db.", "_data.csv")) == "orders"
