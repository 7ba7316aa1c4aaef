from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import backup, windows
from fleetlens.sources import exports

DAY = dt.timedelta(days=1)
NOW = dt.datetime(2024, 6, 1)


@pytest.mark.parametrize("age,cutoff,mtime", [
    (7 * DAY, False, False), (7 * DAY + dt.timedelta(seconds=1), True, False), (8 * DAY - dt.timedelta(seconds=1), True, False),
    (8 * DAY, True, True), (None, False, False)])
def test_both_retention_rules(spark, age, cutoff, mtime):
    catalog = spark.createDataFrame([(None if age is None else NOW - age,)], "created timestamp")
    assert backup.retention_plan(catalog, NOW, 7).head().expired is cutoff
    assert backup.retention_plan(catalog, NOW, 7, "mtime_days").head().expired is mtime


def test_kept_and_expired_are_everything(spark):
    catalog = spark.range(100).select((F.lit(NOW) - F.make_dt_interval(days=F.col("id").cast("int"))).alias("created"), F.lit(1).alias("bytes"))
    plan = backup.retention_plan(catalog, NOW, 30)
    assert plan.filter("expired").count() + plan.filter("not expired").count() == 100
    assert backup.retention_counts(plan, []).head().expired == 69


def test_audit_names_objects_without_recent_success(spark, rows):
    catalog = spark.createDataFrame([
        ("a", NOW - 2 * DAY, "Success", 1), ("b", NOW - 2 * DAY, "Failed", 1), ("b", NOW - 40 * DAY, "Success", 1)],
        "database string, created timestamp, status string, bytes long")
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "database string")
    got = backup.retention_audit(catalog, objects, 7, NOW)
    assert rows(got, "database", "obsolete", "needs_backup") == [("a", 0, False), ("b", 1, True), ("c", 0, True)]


def test_status_order(spark):
    df = spark.createDataFrame([
        (1, True, None, None, None, []), (2, False, "x", None, None, []), (3, False, None, True, False, ["e"]),
        (4, False, None, True, True, ["e"]), (5, False, None, True, True, []), (6, False, None, None, None, None), (7, None, None, True, None, [])],
        "id int, timed_out boolean, failure string, schema_backup boolean, data_copied boolean, errors array<string>")
    assert [r.status for r in backup.backup_status(df).orderBy("id").collect()] == [
        "timeout", "failed", "partial", "completed_with_errors", "success", "success", "partial"]


def test_secrets_stay_out(spark):
    df = spark.createDataFrame([({"host": "h", "Password": "x", "api_token": "y", "user": "u"},)], "c map<string,string>")
    assert df.select(backup.without_secrets("c").alias("c")).head().c == {"host": "h", "user": "u"}


def brute_chain(backups, database, target, max_gap):
    mine = [b for b in backups if b["database"] == database and b["created"] <= target]
    fulls = [b for b in mine if b["type"] == "D"]
    if not fulls:
        return None
    full = max(fulls, key=lambda b: (b["created"], b["backup_id"]))
    diffs = [b for b in mine if b["type"] == "I" and b["created"] > full["created"]]
    base = max(diffs, key=lambda b: (b["created"], b["backup_id"])) if diffs else full
    logs = sorted((b for b in backups if b["database"] == database and b["type"] == "L"), key=lambda b: (b["created"], b["backup_id"]))
    picked, gaps = [], 0
    for before, log in zip([None, *logs], logs):
        if base["created"] < log["created"] <= target:
            picked.append(log)
            gaps += before is not None and (log["created"] - before["finished"]).total_seconds() > max_gap
    return (full["backup_id"], base["backup_id"] if diffs else None, len(picked), sum(b["bytes"] for b in picked), gaps)


@pytest.mark.parametrize("width", [3600.0, 86400.0, 1e10])
def test_restore_chain_matches_brute_force(spark, width):
    rng = random.Random(11)
    backups, start = [], dt.datetime(2023, 1, 1)
    for i in range(1500):
        created = start + dt.timedelta(hours=rng.randrange(24 * 400))
        backups.append({"database": "hot" if rng.random() < 0.4 else f"d{rng.randrange(8)}", "backup_id": i,
                        "type": rng.choices("DIL", [1, 2, 8])[0], "created": created,
                        "finished": created + dt.timedelta(hours=rng.randrange(30)), "bytes": rng.randrange(1000)})
    targets = [(db, i, start + dt.timedelta(hours=rng.randrange(-100, 24 * 420)))
               for i, db in enumerate(["hot"] * 40 + [f"d{k}" for k in range(8)] * 4 + ["none"])]
    ddl = "database string, backup_id long, type string, created timestamp, finished timestamp, bytes long"
    table = spark.createDataFrame([tuple(b.values()) for b in backups], ddl)
    wanted = spark.createDataFrame(targets, "database string, target_id long, target_ts timestamp")
    chain = backup.restore_chain(table, wanted, max_gap=3600.0, width=width).cache()
    got = {(r.database, r.target_id): r for r in chain.collect()}
    assert len(got) == len(targets)
    for database, target_id, at in targets:
        row, expected = got[(database, target_id)], brute_chain(backups, database, at, 3600.0)
        if expected is None:
            assert not row.restorable and not row.continuous and row.full_id is None
        else:
            assert (row.full_id, row.differential_id, row.logs, row.log_bytes, row.gaps) == expected
            assert row.restorable and row.continuous == (expected[4] == 0)
    members = backup.restore_members(table, chain, [0, 1]).groupBy("target_id").count().collect()
    assert {r.target_id: r["count"] for r in members} == {i: got[("hot", i)].logs for i in (0, 1) if got[("hot", i)].logs}


def test_long_term_retention_in_calendar_units(spark, rows):
    dates = ["2024-05-27", "2024-05-28", "2024-06-01", "2024-03-04", "2024-01-01", "2023-06-15", "2023-01-02", "2019-07-01", "2018-01-01"]
    df = spark.createDataFrame([("a", i, dt.datetime.fromisoformat(d)) for i, d in enumerate(dates)],
                               "database string, backup_id int, created timestamp")
    got = windows.ltr_keep(df, NOW)
    assert rows(got, "backup_id", "weekly", "monthly", "yearly") == [
        (0, True, True, False),   # Monday of the week, first of May
        (2, False, True, False),  # first of June, but not of its week
        (3, False, True, False),  # first of March, thirteen weeks old
        (4, False, True, True),   # first of January and of the year
        (5, False, True, False),  # first of its month, within twelve months
        (6, False, False, True),  # first of 2023
        (7, False, False, True),  # first of 2019, within five years
    ]


def test_catalog_lists_strangers_as_unknown(spark, tmp_path):
    root = str(tmp_path / "backups")
    table = spark.range(10).toDF("id")
    exports.export_database(spark, {"t": table, "empty": table.limit(0)}, f"{root}/good", "good")
    exports.export_database(spark, {"t": table}, f"{root}/schema", "schema", include_data=False)
    table.write.parquet(f"{root}/odd/data/t")
    got = {r.name: r for r in backup.backup_catalog(spark, root).collect()}
    assert (got["good"].status, got["good"].has_schema, got["good"].has_data, got["good"].tables, got["good"]["rows"]) == ("success", True, True, 2, 10)
    assert (got["schema"].has_schema, got["schema"].has_data) == (True, False)
    assert (got["odd"].status, got["odd"].has_data, got["odd"].created_at) == ("Unknown", True, None)
    assert backup.backup_catalog(spark, root).collect()[-1].name == "odd"


def test_catalog_without_any_manifest(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "backups" / "odd" / "data" / "t"))
    got = backup.backup_catalog(spark, str(tmp_path / "backups")).collect()
    assert [(r.name, r.status, r.has_schema, r.has_data) for r in got] == [("odd", "Unknown", False, True)]


def test_header_check(spark, tmp_path):
    good, late = tmp_path / "d" / "good.sql", tmp_path / "d" / "late.sql"
    good.parent.mkdir()
    good.write_text("--\n-- Database Export\nINSERT\n")
    late.write_text("\n".join(["--"] * 5 + ["-- Database Export"]))
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in backup.verify_header(spark, str(tmp_path / "d"), ["Database Export"]).collect()}
    assert got == {"good.sql": True, "late.sql": False}


def test_plan_stops_when_the_budget_is_used(spark):
    df = spark.createDataFrame([("s", i, "REBUILD", 1, 90.0 - i, 100) for i in range(5)] + [("s", 9, "NONE", 3, 1.0, 5)],
                               "server_id string, object_id int, operation string, priority int, fragmentation_percent double, page_count long")
    plan = windows.maintenance_plan(df, 250, F.col("page_count"), ["server_id"], tie=["object_id"])
    assert sorted((r.object_id, r.elapsed_before) for r in plan.collect()) == [(0, 0), (1, 100), (2, 200)]
    first = windows.maintenance_plan(df, 1, F.col("page_count"), ["server_id"], tie=["object_id"])
    assert [r.object_id for r in first.collect()] == [0]


def test_counter_reset_gives_no_rate(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    df = spark.createDataFrame([("a", at(0), 10), ("a", at(10), 30), ("a", at(20), 5), ("a", at(20), 6)], "s string, ts timestamp, ops long")
    got = windows.counter_rate(df, ["s"], "ts", ["ops"], tie=["ops"]).orderBy("ts", "ops").collect()
    assert [(r.ops_delta, r.ops_rate, r.ops_reset) for r in got] == [
        (None, None, False), (20, 2.0, False), (None, None, True), (1, None, False)]


def test_status_dumps_are_cut_over_files(spark, tmp_path):
    """No file holds a whole long dump; in the order of their names they are the sorted dump, its mark first."""
    from fleetlens.plans.backup import status_dumps
    orders = spark.range(4000).select((F.col("id") * 7 % 4000).alias("o_orderkey"), F.when(F.col("id") % 10 == 0, "P").otherwise("O").alias("o_orderstatus"))
    status_dumps(orders, str(tmp_path / "dumps"), rows=400)
    for status, n in (("O", 3600), ("P", 400)):
        parts = [path.read_text().splitlines() for path in sorted((tmp_path / "dumps" / f"o_orderstatus={status}").glob("part-*"))]
        assert max(map(len, parts)) <= 1200 and (status == "P" or len(parts) >= 5)
        mark, *lines = [line for part in parts for line in part]
        found = [int(line.split(":")[1].split(",")[0]) for line in lines]
        assert mark == "-- Database Export" and len(found) == n and found == sorted(found)
