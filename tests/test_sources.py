from __future__ import annotations

import datetime as dt

import pytest

from fleetlens.functions.columns import names
from fleetlens.sources import backup_reports, logs, schemas, telemetry

LINES = [
    ("[2024-01-02 03:04:05] [WARN] low space", ("WARN", "low space", "bracketed")),
    ("[2024-01-02 03:04:05] ERROR: it broke: badly", ("ERROR", "it broke: badly", "colon")),
    ("\x1b[0;31m[2024-01-02 03:04:05] ERROR: red\x1b[0m", ("ERROR", "red", "colon")),
    ("2024-01-02 03:04:05,123 - WARNING - python - dashes", ("WARN", "python - dashes", "dashed")),
    ("[2024-01-02 03:04:05] no level here", (None, "no level here", "plain")),
]


@pytest.mark.parametrize("line,expected", LINES)
def test_log_layouts(spark, line, expected):
    row = logs.parse_logs(spark.createDataFrame([("f", line)], "path string, value string")).head()
    assert (row.level, row.message, row.layout) == expected
    assert row.ts == dt.datetime(2024, 1, 2, 3, 4, 5)


@pytest.mark.parametrize("line", ["RMAN-03009: failure", "", "[2024-13-99 99:99:99] [INFO] bad date"])
def test_unreadable_lines_are_kept(spark, line):
    row = logs.parse_logs(spark.createDataFrame([("f", line)], "path string, value string")).head()
    assert row.ts is None and (row.layout is None or row.message == "bad date")
    assert row.message in (line, "bad date")


def test_first_lines_of_each_file(spark, tmp_path, rows):
    for name in ("a", "b"):
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(20)))
    got = logs.first_lines(spark, str(tmp_path), 2)
    assert rows(got, "line_no", "value") == [(1, "a0"), (1, "b0"), (2, "a1"), (2, "b1")]


def test_report_layouts(spark, tmp_path):
    samples = {
        "db2": "2024-01-02 03:04:05,inst,db,ONLINE,Success,/p,12,4.0K",
        "oracle": "2024-01-02 03:04:05,ORCL,FULL,Failed,/p,N/A",
        "influxdb": "2024-01-02 03:04:05,h:8086,v2,bucket,Connection Failed,Unknown,7,/p",
        "mysql": "2024-01-02 03:04:05,db,Failed,,0B,0,h:3306",
        "postgresql": "2024-01-02 03:04:05,db,Success,/p,1.5MiB,N/A",
        "sqlserver": '"1/2/2024 3:04:05 AM","srv","db","FULL","/p","2.5","Success","N/A"',
        "postgresql_windows": '"1/2/2024 3:04:05 AM","db","/p","2048","Success"',
    }
    for layout, line in samples.items():
        (tmp_path / f"{layout}.csv").write_text(f"{backup_reports.LAYOUTS[layout]}\n{line}\n")
    paths = {layout: str(tmp_path / f"{layout}.csv") for layout in samples}
    got = {r.layout: r for r in backup_reports.read_backup_reports(spark, paths).collect()}
    assert {r.ts for r in got.values()} == {dt.datetime(2024, 1, 2, 3, 4, 5)}
    assert {k: r.size_bytes for k, r in got.items()} == {
        "db2": 4096.0, "oracle": None, "influxdb": None, "mysql": 0.0, "postgresql": 1572864.0, "sqlserver": 2.5 * 1048576, "postgresql_windows": 2048.0}
    assert {k: r.duration_seconds for k, r in got.items()} == {
        "db2": 12.0, "oracle": None, "influxdb": 7.0, "mysql": 0.0, "postgresql": None, "sqlserver": None, "postgresql_windows": None}
    assert got["influxdb"].status == "Connection Failed" and got["oracle"].database == "ORCL"


def test_append_replaces_only_its_own_run(spark, tmp_path, rows):
    path = str(tmp_path / "r")
    make = lambda *v: spark.createDataFrame([(x,) for x in v], "v int")
    backup_reports.append_report(make(1), path, "a")
    backup_reports.append_report(make(2, 3), path, "b")
    backup_reports.append_report(make(4), path, "a")
    assert rows(backup_reports.read_report(spark, path), "v") == [(2,), (3,), (4,)]


@pytest.mark.parametrize("view", sorted(schemas.VIEWS))
def test_view_schemas_parse(view):
    fields = schemas.schema_of(view).fieldNames()
    assert fields[:2] == ["server_id", "snapshot_ts"] and len(fields) == len(set(fields))


def test_read_telemetry_fills_missing_columns(spark, tmp_path):
    spark.createDataFrame([("s", "a", "b")], "server_id string, name string, value string").write.json(str(tmp_path / "j"))
    got = telemetry.read_telemetry(spark, str(tmp_path / "j"), "settings", fmt="json").head()
    assert (got.server_id, got.snapshot_ts, got.name, got.value) == ("s", None, "a", "b")


def test_names():
    assert names(None) == [] and names("a") == ["a"] and names(("a", "b")) == ["a", "b"]
