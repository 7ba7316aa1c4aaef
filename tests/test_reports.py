"""Edges of the named reports."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, filters, reports

NOW = dt.datetime(2024, 1, 1, 12)
SESSION_DDL = ("pid int, usename string, application_name string, client_addr string, backend_start timestamp, state string, "
               "query_start timestamp, query string")


def session(pid, state, seconds):
    start = None if seconds is None else NOW - dt.timedelta(seconds=seconds)
    return (pid, "u", "app", "addr", NOW, state, start, "q" * 300)


@pytest.fixture(scope="module")
def sessions(spark):
    rows = [session(1, "active", 300), session(2, "active", 300.001), session(3, "idle", 900), session(4, "active", None),
            session(5, "active", 901), session(9, "active", 5000)]
    return spark.createDataFrame(rows, SESSION_DDL)


def test_active_sessions_longest_first_unknown_last(sessions):
    got = filters.active_sessions(sessions, NOW, self_pid=9).collect()
    assert [r.pid for r in got] == [5, 2, 1, 4]
    assert len(got[0].current_query) == 100 and got[-1].query_seconds is None


def test_five_minutes_are_not_yet_long(sessions):
    got = filters.long_running_sessions(sessions, NOW, self_pid=9)
    assert sorted(r.pid for r in got.collect()) == [2, 5]
    assert len(got.head().query_text) == 200
    inclusive = filters.long_running(sessions, "query_start", NOW, 300.0, inclusive=True)
    assert sorted(r.pid for r in inclusive.collect()) == [1, 2, 3, 5, 9]


def test_operations_from_ten_seconds_on(spark, rows):
    ops = spark.createDataFrame([
        (1, "query", "db.c", 9, None, "{}", True), (2, "query", "db.c", 10, "h:1", "{}", True), (3, "none", "", 99, "h", "{}", True),
        (4, "query", "db.c", 99, None, "{}", False)], "opid long, op string, ns string, secs_running long, client string, command string, active boolean")
    assert rows(filters.current_operations(ops, 10), "opid", "client") == [(2, "h:1")]
    assert rows(filters.current_operations(ops), "opid", "client", "command") == [(1, "N/A", "{}..."), (2, "h:1", "{}...")]


def test_unused_index_must_be_larger_than_a_megabyte(spark, rows):
    indexes = spark.createDataFrame([
        ("s", "t", "at", 0, 1048576, 0, 0), ("s", "t", "over", 0, 1048577, 0, 0), ("s", "t", "used", 1, 9999999, 5, 5)],
        "schemaname string, tablename string, indexname string, idx_scan long, index_bytes long, idx_tup_read long, idx_tup_fetch long")
    assert rows(reports.unused_indexes(indexes), "indexname", "index_size") == [("over", "1.0 MB")]
    usage = {r.indexname: r.fetch_ratio_percent for r in reports.index_usage(indexes).collect()}
    assert usage == {"at": 0.0, "over": 0.0, "used": 100.0}


TABLE_DDL = ("schemaname string, tablename string, seq_scan long, seq_tup_read long, n_tup_ins long, n_tup_upd long, n_tup_del long, "
             "n_live_tup long, n_dead_tup long, n_mod_since_analyze long, last_vacuum timestamp, last_autovacuum timestamp, "
             "last_analyze timestamp, last_autoanalyze timestamp, total_bytes long, table_bytes long")


def table(name, scans=0, read=0, live=0, dead=0, modified=0, total=0, schema="public"):
    return (schema, name, scans, read, 1, 2, 3, live, dead, modified, None, None, None, None, total, total // 2)


def test_table_candidates(spark, rows):
    tables = spark.createDataFrame([
        table("edge", 100, 1001, 10, 1000, 1000), table("many", 101, 1001, 0, 1001, 1001), table("few", 101, 1000, 4000, 2000, 5)], TABLE_DDL)
    assert rows(reports.missing_index_candidates(tables), "tablename", "total_writes") == [("many", 6)]
    assert rows(reports.vacuum_candidates(tables), "tablename", "dead_tuple_percent") == [("few", 50.0), ("many", None)]
    assert [r.tablename for r in reports.vacuum_candidates(tables).collect()] == ["few", "many"]
    assert rows(reports.analyze_candidates(tables), "tablename") == [("many",)]


def test_largest_tables_leave_out_system_schemas(spark):
    tables = spark.createDataFrame([table("a", total=2048), table("b", total=4096), table("c", total=99999, schema="pg_catalog")], TABLE_DDL)
    got = reports.table_sizes(tables, n=5).collect()
    assert [(r.tablename, r.total_size, r.index_size) for r in got] == [("b", "4.0 KB", "2.0 KB"), ("a", "2.0 KB", "1.0 KB")]


def test_statement_without_blocks_has_no_ratio(spark):
    statements = spark.createDataFrame([("q1", 1, 5.0, 5.0, 1, 0, 0), ("q2", 9, 3.0, 0.3, 1, 3, 1)],
                                       "query string, calls long, total_time double, mean_time double, rows long, shared_blks_hit long, shared_blks_read long")
    assert [r.hit_percent for r in reports.top_queries(statements).collect()] == [None, 75.0]
    assert reports.top_queries(statements, "calls", 1).head().query_snippet == "q2"


def test_cache_ratio_filter_hides_perfect_databases(spark, rows):
    stats = spark.createDataFrame([("a", 10, 0), ("b", 9, 1), ("c", 0, 0)], "datname string, blks_hit long, blks_read long")
    assert rows(aggregates.cache_hit_ratio(stats, ["datname"]), "datname", "cache_hit_ratio") == [("a", 100.0), ("b", 90.0), ("c", None)]
    assert rows(aggregates.cache_hit_ratio(stats, ["datname"], only_with_reads=True), "datname") == [("b",)]
    assert aggregates.cache_hit_ratio(stats).head().cache_hit_ratio == 95.0


def test_storage_cache_ratio_both_ways(spark):
    got = reports.store_cache_ratios(spark.createDataFrame([(25, 75), (0, 0)], "pages_read_in long, pages_requested long")).collect()
    assert round(got[0].hit_ratio, 6) == round(200 / 3, 6) and got[0].ref_ratio == 25.0
    assert got[1].hit_ratio is None and got[1].ref_ratio is None


def test_nested_nodes_and_packed_keyspaces(spark, rows):
    ddl = ("id string, nodes array<struct<id:string,host:string,port:int,flags:array<string>,master:string,slots:array<string>>>, "
           "keyspace map<string,string>")
    df = spark.createDataFrame([
        ("c", [("n1", "h", 6379, ["master", "myself"], None, ["0-1"]), (None, None, None, None, "n1", None)], {"db0": "keys=2,expires=1,avg_ttl=0", "x": "y"}),
        ("empty", [], {})], ddl)
    assert rows(reports.cluster_nodes(df, ["id"]).select(
        F.col("host"), F.col("port"), "master", "is_master", "slot_ranges")) == [
        ("Unknown", 0, "n1", False, 0), ("h", 6379, "Unknown", True, 1)]
    assert rows(reports.keyspace_info(df, ["id"]), "database", "keys", "expires", "avg_ttl") == [("db0", 2, 1, 0)]


def test_server_report_keeps_servers_known_to_one_section(spark):
    info = spark.createDataFrame([("a", 1), ("b", 2)], "s string, v int")
    runs = spark.createDataFrame([("a", i) for i in range(9)] + [("c", 1)], "s string, at int")
    got = {r.s: r for r in reports.server_report({"info": info}, ["s"], {"last": (runs, [F.desc("at")], 3)}).collect()}
    assert [x.at for x in got["a"]["last"]] == [8, 7, 6]
    assert got["b"]["last"] is None and got["c"]["info"] is None


def test_shards_need_two(spark, rows):
    chunks = spark.createDataFrame([("one", "s1")] * 3 + [("two", "s1")] * 4 + [("two", "s2")], "ns string, shard string")
    assert rows(aggregates.shard_distribution(chunks), "ns", "shard", "chunks", "skew") == [("two", "s1", 4, 4.0), ("two", "s2", 1, 4.0)]


def test_key_profile(spark):
    keys = spark.createDataFrame([("u:1", "hash", 10), ("u:2", "hash", None), ("u:3", "set", 5), ("plain", "string", 1)],
                                 "key string, type string, bytes long")
    got = {r.pattern: r for r in aggregates.top_patterns(keys, samples=2).collect()}
    assert (got["u"]["count"], got["u"].total_size, got["u"].max_size, got["u"].avg_size) == (3, 15, 10, 5.0)
    assert got["u"].types == {"hash": 2, "set": 1} and got["u"].sample_keys == ["u:1", "u:2"]
    assert got["simple"].sample_keys == ["plain"]


def test_log_summary(spark):
    lines = ["piece handle=/a", "input datafile size=1.5G x", "output size=900M", "RMAN-03009: failure", "ORA-19502: write", "output size=950M", "FAILED"]
    df = spark.createDataFrame([("l", i, v) for i, v in enumerate(lines)] + [("quiet", 0, "ok")], "path string, line_no long, value string")
    got = {r.path: r for r in aggregates.backup_log_summary(df).collect()}
    assert (got["l"].pieces, got["l"].input_size, got["l"].output_size, got["l"].error_lines, got["l"].validation) == (1, "1.5G", "950M", 2, "ISSUES_FOUND")
    assert (got["quiet"].input_size, got["quiet"].validation) == ("Unknown", "VALID")
    assert [r.codes for r in aggregates.backup_log_errors(df).orderBy("line_no").collect()] == [["RMAN-03009"], ["ORA-19502"]]
    assert [r.line_no for r in aggregates.log_tail(df.filter("path = 'l'"), 2).orderBy("line_no").collect()] == [5, 6]


def test_whole_number_success_rate(spark):
    df = spark.createDataFrame([("Success",), ("Success",), ("Failed",), ("Connection Failed",), ("Success late",), ("Failed",)], "status string")
    got = aggregates.backup_success_rate(df, int_pct=True).head()
    assert (got.total, got.successful, got.failed, got.success_rate) == (6, 2, 4, 33)


def test_eligibility(spark):
    df = spark.createDataFrame([("app", "ONLINE", "FULL"), ("app", "ONLINE", "SIMPLE"), ("model", "ONLINE", "FULL"), ("app", "OFFLINE", "FULL"), ("app", None, "FULL")],
                               "name string, state_desc string, recovery_model_desc string")
    assert [r.eligible for r in filters.backup_eligibility(df).collect()] == [True, False, False, False, False]
    assert [r.eligible for r in filters.backup_eligibility(df, "FULL").collect()] == [True, True, True, False, False]


def test_hourly_metrics_round_half_to_even(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    points = spark.createDataFrame([("cpu", at(1, 0), 0.125), ("cpu", at(1, 30), 0.125), ("cpu", at(2, 0), 0.125), ("old", at(0, 0) - dt.timedelta(days=2), 9.0)],
                                   "metric string, ts timestamp, value double")
    got = aggregates.hourly_metrics(points, NOW).collect()
    assert [(r.metric, r.average, r.maximum) for r in got] == [("cpu", 0.12, 0.12)]
