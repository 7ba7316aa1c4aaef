"""Reads that stop early: heads of files, logs by spans, hash trees."""

from __future__ import annotations

import datetime as dt
import gzip
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import backup, movement
from fleetlens.sources import files

START = dt.datetime(2024, 1, 1)


def test_heads_are_bounded(spark, tmp_path):
    folder = tmp_path / "dumps" / "deep"
    folder.mkdir(parents=True)
    (folder / "long.sql").write_text("-- Database Export\n" + "INSERT;\n" * 500_000)
    (folder / "one_line.sql").write_text("x" * 3_000_000 + "Database Export")
    (folder / "empty.sql").write_text("")
    (folder / "bad.sql").write_bytes(b"\xff\xfe Database Export")
    (folder / "late.sql").write_text("1\n2\n3\n4\n5\nDatabase Export\n")
    with gzip.open(folder / "zipped.sql.gz", "wt") as out:
        out.write("--\n-- Database Export\n" + "INSERT;\n" * 500_000)
    got = {r.path.rsplit("/", 1)[1]: r for r in backup.verify_header(spark, str(tmp_path / "dumps"), ["CREATE DATABASE", "Database Export"]).collect()}
    assert {name: r.valid for name, r in got.items()} == {
        "long.sql": True, "one_line.sql": False, "bad.sql": True, "late.sql": False, "zipped.sql.gz": True}
    assert all(r.read_bytes <= files.HEAD_BYTES for r in got.values())
    assert got["long.sql"].read_bytes == 4 << 10 and got["long.sql"].bytes > 4_000_000
    assert [r.lines for r in files.file_heads(spark, str(folder / "late.sql"), 2).collect()] == [["1", "2"]]


@pytest.mark.parametrize("width", [3600.0, 86400.0, 40 * 86400.0])
def test_members_and_counts_match_brute_force(spark, width):
    draw = random.Random(7)
    logs = [(draw.choice(["a", "b", None]), i, "L", START + dt.timedelta(minutes=draw.randrange(0, 20_000, 30)), draw.randrange(100)) for i in range(300)]
    chain = [(draw.choice(["a", "b"]), i, START + dt.timedelta(minutes=b), START + dt.timedelta(minutes=b + n))
             for i, (b, n) in enumerate((draw.randrange(0, 20_000, 30), draw.randrange(0, 9000, 30)) for _ in range(25))]
    chain += [("a", 90, None, START), ("b", 91, START + dt.timedelta(9), START)]
    table = spark.createDataFrame(logs + [("a", 999, "D", START, 5), ("a", 998, "L", None, 5)], "database string, backup_id long, type string, created timestamp, bytes long")
    wanted = spark.createDataFrame(chain, "database string, target_id long, base_ts timestamp, target_ts timestamp")
    brute = {(t, i): (created, size) for d, t, base, goal in chain for db, i, _, created, size in logs
             if base and db == d and base < created <= goal}
    members = backup.restore_members(table, wanted, width=width).collect()
    assert {(r.target_id, r.backup_id) for r in members} == set(brute) and len(members) == len(brute) > 100
    assert {r.target_id for r in backup.restore_members(table, wanted, [3, 4], width=width).collect()} <= {3, 4}
    spans = {}
    for (target, _), (created, size) in brute.items():
        seconds = (created - dt.datetime(1970, 1, 1)).total_seconds()
        at = spans.setdefault((target, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=seconds // width * width)), [0, 0])
        at[0] += 1
        at[1] += size
    counts = backup.restore_member_counts(table, wanted, width=width)
    assert {(r.target_id, r.span_start): [r.logs, r.log_bytes] for r in counts.collect()} == spans


@pytest.mark.parametrize("kind", ["long", "int", "date", "timestamp", "string"])
def test_differences_are_located(spark, kind):
    key = {"date": F.date_from_unix_date(F.col("id").cast("int")), "timestamp": F.timestamp_seconds("id"), "string": F.concat(F.lit("k"), "id")}
    base = spark.range(-500, 3000).select(key.get(kind, F.col("id").cast(kind)).alias("k"), F.col("id").alias("v"))
    base = base.unionByName(spark.createDataFrame([(None, 5)], f"k {base.schema['k'].dataType.simpleString()}, v long"))
    other = base.filter("v <> 700 or v is null").withColumn("v", F.when(F.col("v") == 2500, -1).otherwise(F.col("v")))
    width = 1_000_000 * 64 if kind == "timestamp" else (1 << 60) if kind == "string" else 64
    ranges = movement.locate_difference(base, other, ["k"], width=width, fan=4).collect()
    assert 1 <= len(ranges) <= 2 and sum(r.source_rows - r.copy_rows for r in ranges) == 1
    if kind in ("long", "int"):
        assert {(r.range_from, r.range_to) for r in ranges} == {(640, 704), (2496, 2560)}
    diff = movement.ranged_diff(base, other, ["k"], width=width, fan=4)
    assert sorted(r.change for r in diff.collect()) == ["delete", "update"]


def test_equal_tables_have_no_range(spark):
    base = spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    same = base.repartition(7).select("v", "k")
    assert movement.locate_difference(base, same, ["k"]).collect() == [] and movement.ranged_diff(base, same, ["k"]).collect() == []
    assert movement.locate_difference(base.limit(0), same.limit(0), ["k"]).collect() == []
    assert movement.locate_difference(base.limit(0), same, ["k"], width=100).count() == 10


def test_null_keys_and_swapped_values_are_seen(spark):
    base = spark.createDataFrame([(None, "a", "b"), (1, None, "c")], "k long, v string, w string")
    moved = spark.createDataFrame([(None, "a", "x"), (1, "c", None)], "k long, v string, w string")
    assert len(movement.locate_difference(base, moved, ["k"]).collect()) == 2
    assert movement.ranged_diff(base, moved, ["k"]).count() == 2


def test_only_children_of_unlike_nodes_are_compared(spark):
    """A stored tree is compared without its table, and a part of it that cannot differ is never read."""
    base = spark.range(100_000).select(F.col("id").alias("k"), F.col("id").alias("v"))
    one, two = (movement.hash_tree(df, ["k"], width=10, fan=10) for df in (base, base.filter("k <> 77777")))
    assert one.groupBy("level").count().orderBy("level").collect() == [(0, 10_000), (1, 1000), (2, 100), (3, 10)]
    assert [(r.range_from, r.range_to) for r in movement.compare_trees(one, two, 10, 10).collect()] == [(77_770, 77_780)]
    # Leaves elsewhere may hold anything: their parents are equal.
    strange = two.withColumn("rows", F.when((F.col("level") == 0) & (F.col("node") < 5000), -1).otherwise(F.col("rows")))
    assert [(r.range_from, r.range_to) for r in movement.compare_trees(one, strange, 10, 10).collect()] == [(77_770, 77_780)]
