from __future__ import annotations

import datetime as dt
import decimal
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, movement
from fleetlens.sources import exports, files

NASTY = [
    (1, "plain", 1.5, [1.0, 2.0], {"a": 1}, bytearray(b"\x00\n"), decimal.Decimal("1.20"), dt.datetime(2024, 1, 2, 3, 4, 5, 678901), True),
    (2, "", None, [], {}, bytearray(b""), None, None, None),
    (3, None, float("inf"), None, None, None, decimal.Decimal("0.00"), dt.datetime(1969, 12, 31), False),
    (4, 'quote " comma , back\\slash', -0.1, [float("1e300")], {"k,": -1}, None, None, None, None),
    (5, " lead and trail ", 1e-300, None, None, None, None, None, None),
    (6, "line\nbreak\r\nand %0A and %25 and %", 0.1, None, None, None, None, None, None),
    (7, "\\N", 3.0, None, None, None, None, None, None),
    (8, "été 漢字 🙂\ttab", 3.0, None, None, None, None, None, None),
    (9, '""', 3.0, None, None, None, None, None, None),
    (10, '"', 3.0, None, None, None, None, None, None),
]
DDL = "id int, s string, d double, a array<double>, m map<string,int>, b binary, n decimal(10,2), t timestamp, f boolean"


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export_and_restore_lose_nothing(spark, tmp_path, fmt):
    df = spark.createDataFrame(NASTY, DDL).withColumn("ntz", F.col("t").cast("timestamp_ntz"))
    path = str(tmp_path / "x")
    manifest = exports.export_database(spark, {"nasty": df, "empty": df.limit(0)}, path, "b", fmt=fmt, parallelism=3)
    assert {r["table"]: (r["rows"], r["error"]) for r in manifest.collect()} == {"nasty": (10, None), "empty": (0, None)}
    back = exports.restore_database(spark, path)
    assert back["nasty"].schema.simpleString() == df.schema.simpleString()
    assert sorted(back["nasty"].collect(), key=lambda r: r.id) == sorted(df.collect(), key=lambda r: r.id)
    assert back["empty"].count() == 0 and back["empty"].schema == df.schema
    assert movement.verify_copy(df, back["nasty"], "nasty").head().content_matches


def test_a_failing_table_does_not_stop_the_others(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("boom")).cast("string").alias("x"))
    manifest = exports.export_database(spark, {"bad": bad, "good": spark.range(3).toDF("id")}, str(tmp_path / "x"), "b")
    got = {r["table"]: (r["rows"], r["error"] is not None) for r in manifest.collect()}
    assert got == {"bad": (0, True), "good": (3, False)}
    assert set(exports.restore_database(spark, str(tmp_path / "x"))) == {"good"}


def test_restore_needs_a_manifest(spark, tmp_path):
    with pytest.raises(Exception):
        exports.restore_database(spark, str(tmp_path / "nothing"))


def test_restore_into_another_database(spark, tmp_path):
    exports.export_database(spark, {"t": spark.range(5).toDF("id")}, str(tmp_path / "x"), "b")
    name = f"copy_{random.randrange(10 ** 9)}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{tmp_path / 'db'}'")
    exports.restore_into(spark, str(tmp_path / "x"), name)
    assert spark.table(f"{name}.t").count() == 5
    spark.sql(f"DROP DATABASE {name} CASCADE")


def test_fingerprint_sees_duplicates_and_order_does_not_matter(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    assert movement.verify_copy(one, one.orderBy(F.desc("id")), "t").head().content_matches
    thrice = one.union(one).union(one)
    assert not movement.verify_copy(one, thrice, "t").head().content_matches
    swapped = spark.createDataFrame([(1, "b"), (2, "a")], "id int, s string")
    assert not movement.verify_copy(one, swapped, "t").head().content_matches


@pytest.mark.parametrize("seed", range(3))
def test_replaying_a_diff_gives_the_current_table(spark, seed):
    rng = random.Random(seed)
    base = {k: rng.choice([None, 1, 2]) for k in range(60) if rng.random() < 0.7}
    now = {k: (rng.choice([None, 1, 2]) if rng.random() < 0.5 else base.get(k)) for k in range(60) if rng.random() < 0.7}
    make = lambda d: spark.createDataFrame(list(d.items()) or [], "k int, v int")
    diff = movement.table_diff(make(base), make(now), ["k"]).cache()
    kinds = {r.k: r.change for r in diff.collect()}
    for k in range(60):
        expected = None
        if k in now and k not in base:
            expected = "insert"
        elif k in base and k not in now:
            expected = "delete"
        elif k in base and base[k] != now[k]:
            expected = "update"
        assert kinds.get(k) == expected
    log = diff.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "seq": F.lit(1)})
    assert {r.k: r.v for r in movement.apply_changes(make(base), log, ["k"]).collect()} == now


def test_last_change_wins(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    t = lambda d: dt.datetime(2024, 1, d)
    log = spark.createDataFrame([
        (1, None, "delete", t(1), 1), (1, "back", "insert", t(1), 2), (2, "x", "update", t(1), 1), (2, None, "delete", t(2), 1),
        (3, "new", "insert", t(1), 1), (3, "late", "update", t(9), 1)], "k int, v string, change string, ts timestamp, seq int")
    assert rows(movement.apply_changes(base, log, ["k"], until=t(5))) == [(1, "back"), (3, "new")]


def test_compaction_keeps_every_row(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    df = spark.range(1000).select((F.col("id") % 10).alias("k"), F.lit("x").alias("s"))
    df.repartition(12).write.parquet(src)
    report = {r.stage: r.files for r in movement.compact(spark, src, dst, 3).collect()}
    assert report == {"before": 12, "after": 3}
    assert movement.verify_copy(df, spark.read.parquet(dst), "t").head().content_matches


def test_compaction_keeps_the_newest_row_of_a_key(spark, tmp_path, rows):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "k int, version int, v string").write.parquet(src)
    movement.compact(spark, src, dst, 1, ["k"], [F.desc("version")])
    assert rows(spark.read.parquet(dst), "k", "v") == [(1, "new"), (2, "only")]


def test_reindex_counts(spark, tmp_path):
    got = movement.reindex(spark.range(10).toDF("id"), str(tmp_path / "d"), F.col("id") < 4).head()
    assert (got.status, got.source_rows, got.copied_rows) == ("completed", 10, 4)


@pytest.mark.parametrize("where,copied", [("false", 0), ("id > 100", 0), (None, 10)])
def test_reindex_counts_when_nothing_is_left(spark, tmp_path, where, copied):
    condition = None if where is None else F.expr(where)
    got = movement.reindex(spark.range(10).toDF("id"), str(tmp_path / "d"), condition).head()
    assert (got.source_rows, got.copied_rows) == (10, copied)


def test_exports_of_empty_plans(spark, tmp_path):
    empty = spark.range(10).join(spark.range(100, 110), "id").groupBy("id").count()
    assert exports.export_ndjson(empty, str(tmp_path / "n")).head().documents == 0
    assert exports.export_ndjson(spark.range(0).toDF("id"), str(tmp_path / "m")).head().documents == 0
    manifest = exports.export_database(spark, {"e": empty}, str(tmp_path / "x"), "b").head()
    assert (manifest["rows"], manifest["error"]) == (0, None)


def test_series_without_a_policy_are_kept(spark, rows):
    at = lambda d: dt.datetime(2024, 1, d)
    points = spark.createDataFrame([("a", at(1)), ("a", at(9)), ("b", at(1))], "measurement string, ts timestamp")
    policies = spark.createDataFrame([("a", 2)], "measurement string, days int")
    kept = movement.enforce_series_retention(points, policies, at(10))
    assert rows(kept) == [("a", at(9)), ("b", at(1))]


def test_job_states(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    ddl = "job_id string, ts timestamp, state string, total int, successful int, reason string"
    events = spark.createDataFrame([
        ("a", at(0), "STARTED", 4, 0, None), ("a", at(5), "SUCCESS", 4, 4, None), ("b", at(0), "IN_PROGRESS", 4, 1, None),
        ("c", at(1), "IN_PROGRESS", 0, 0, None), ("d", at(0), "FAILED", 4, 2, "disk"), ("e", at(0), "WEIRD", 4, 2, None)], ddl)
    got = {r.job_id: r for r in movement.job_status(events, dt.datetime(2024, 1, 1, 1, 0)).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "success", "b": "timeout", "c": "running", "d": "failed", "e": "timeout"}
    assert got["a"].duration_seconds == 300.0 and got["b"].progress_percent == 25.0 and got["c"].progress_percent is None
    assert got["d"].reason == "disk"


def test_insert_statements_quote(spark):
    df = spark.createDataFrame([(1, "it's", None)], "id int, s string, x double")
    assert exports.insert_statements(df, "t").head().value == "INSERT INTO \"t\" VALUES(1,'it''s',NULL);"


def test_inventory_reads_no_content(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(b"12345")
    inventory = files.file_inventory(spark, str(tmp_path))
    assert "content" not in inventory.columns
    assert files.inventory_total(inventory).head().asDict() == {"files": 1, "bytes": 5}


def test_copy_tables_by_pattern(spark, tmp_path):
    tables = {name: spark.range(3).toDF("id") for name in ("log_a", "log_b", "other")}
    got = movement.copy_tables(spark, tables, str(tmp_path / "d"), "log_*")
    assert {r["table"] for r in got.collect()} == {"log_a", "log_b"}
    with pytest.raises(ValueError):
        movement.copy_tables(spark, tables, str(tmp_path / "d"), "nothing*")


def test_fingerprints_see_where_values_stand(spark):
    ddl = "k int, a int, b int, x array<int>, y array<int>, m array<map<string,int>>, `d.t` int"
    one = spark.createDataFrame([(1, None, 5, [1, 2], [], [{"p": 1}], 1), (None, 1, 1, None, [], None, 2)], ddl)
    other = spark.createDataFrame([(1, 5, None, [1], [2], [{"p": 1}], 1), (None, 1, 1, [], None, None, 2)], ddl)
    assert movement.verify_copy(one, one, "t").head().content_matches
    assert not movement.verify_copy(one, other, "t").head().content_matches
    assert movement.table_diff(one, one, ["k"]).isEmpty()
    assert sorted(r.change for r in movement.table_diff(one, other, ["k"]).collect()) == ["update", "update"]


def test_null_keys_are_replaced(spark, rows):
    base = spark.createDataFrame([(None, 1, "old"), (2, None, "same")], "k int, l int, v string")
    log = spark.createDataFrame([(None, 1, "new", "update", 1, 1), (2, 3, "more", "insert", 1, 1)],
                                "k int, l int, v string, change string, ts int, seq int")
    assert rows(movement.apply_changes(base, log, ["k", "l"])) == sorted(
        [(None, 1, "new"), (2, None, "same"), (2, 3, "more")], key=str)


def test_dump_loads_elsewhere(spark):
    """DDL and statements of a dump are one dialect, which another engine reads back to the same values."""
    import duckdb
    df = spark.sql("""
        SELECT * FROM VALUES
          (1, "it's\na 'line'", X'00ff27', array('a''b', null), double('NaN'), timestamp_ntz'2024-01-02 03:04:05.000006'),
          (2, '', X'', array(), double('-Infinity'), null),
          (3, null, null, null, 1.5e10, null) AS t(id, `te"xt`, b, `li``st`, x, ts)""")
    con = duckdb.connect()
    con.execute(exports.dump_statement(df, 'd "1"'))
    for row in exports.insert_statements(df, 'd "1"').collect():
        con.execute(row.value.replace("X'00FF27'", "from_hex('00FF27')").replace("X''", "from_hex('')"))
    got = con.execute('SELECT id, "te""xt", b, "li`st", x::VARCHAR, ts FROM "d ""1""" ORDER BY id').fetchall()
    assert got == [
        (1, "it's\na 'line'", b"\x00\xff'", '["a\'b",null]', "nan", dt.datetime(2024, 1, 2, 3, 4, 5, 6)),
        (2, "", b"", "[]", "-inf", None),
        (3, None, None, None, "15000000000.0", None)]


def test_lists_are_cut_per_server(spark):
    rows = [(server, f"db{i}", f"t{i}", i, i) for server in ("a", "b", "c") for i in range(5)]
    tables = spark.createDataFrame(rows, "server_id string, database string, name string, total_rows long, total_bytes long")
    by, per = ["server_id", "database"], ["server_id"]
    assert aggregates.ranked_tables(tables, 2, by, per).count() == 6
    assert aggregates.database_inventory(tables, by, 2, per).count() == 6
