from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import aggregates, rules

CACHE_DDL = ("server_id string, used_memory long, maxmemory long, mem_fragmentation_ratio double, keyspace_hits long, "
             "keyspace_misses long, evicted_keys long, rejected_connections long")


def cache(spark, **changes):
    row = {"server_id": "s", "used_memory": 10, "maxmemory": 10000, "mem_fragmentation_ratio": 1.0, "keyspace_hits": 90,
           "keyspace_misses": 10, "evicted_keys": 0, "rejected_connections": 0, **changes}
    return [(r.severity, r.category) for r in rules.cache_health(spark.createDataFrame([row], CACHE_DDL)).collect()]


@pytest.mark.parametrize("changes,expected", [
    ({}, [("INFO", "General")]),
    ({"used_memory": 7500}, [("INFO", "General")]),
    ({"used_memory": 7501}, [("WARNING", "Memory")]),
    ({"used_memory": 9000}, [("WARNING", "Memory")]),
    ({"used_memory": 9001}, [("CRITICAL", "Memory")]),
    ({"used_memory": 99999, "maxmemory": 0}, [("INFO", "General")]),
    ({"mem_fragmentation_ratio": 1.5}, [("INFO", "General")]),
    ({"mem_fragmentation_ratio": 1.51}, [("WARNING", "Memory")]),
    ({"keyspace_hits": 80, "keyspace_misses": 20}, [("INFO", "General")]),
    ({"keyspace_hits": 79, "keyspace_misses": 21}, [("WARNING", "Performance")]),
    ({"keyspace_hits": 0, "keyspace_misses": 0}, [("INFO", "General")]),
    ({"evicted_keys": 1, "rejected_connections": 2}, [("INFO", "Memory"), ("WARNING", "Connections")]),
])
def test_cache_health(spark, changes, expected):
    assert cache(spark, **changes) == expected


def test_cache_messages(spark):
    row = spark.createDataFrame([("s", 9512, 10000, 1.0, 1, 0, 3, 0)], CACHE_DDL)
    assert [r.message for r in rules.cache_health(row).collect()] == [
        "Memory usage is 95.1% - critically high", "3 keys have been evicted"]


@pytest.mark.parametrize("status,severities", [
    (None, ["CRITICAL"]), ("red", ["CRITICAL"]), ("yellow", ["WARNING"]), ("green", [])])
def test_cluster_status(spark, status, severities):
    clusters = spark.createDataFrame([("c", status, 0)], "cluster_name string, status string, unassigned_shards int")
    objects = spark.createDataFrame([], "cluster_name string, name string, store_size_bytes long")
    assert [r.severity for r in rules.cluster_health(clusters, objects).collect()] == severities


def test_large_index_is_strictly_larger(spark):
    clusters = spark.createDataFrame([("c", "green", 2)], "cluster_name string, status string, unassigned_shards int")
    limit = 50 * 1024 ** 3
    objects = spark.createDataFrame([("c", "at", limit), ("c", "over", limit + 1)], "cluster_name string, name string, store_size_bytes long")
    messages = [r.message for r in rules.cluster_health(clusters, objects).collect()]
    assert messages == ["2 unassigned shards found", "Large index detected: over (50.0 GB)"]


def test_collection_advice_edges(spark, rows):
    servers = spark.createDataFrame([("a", 80, 20, 1), ("b", 81, 19, 0)], "server_id string, current int, available int, profiling_level int")
    collections = spark.createDataFrame(
        [("a", "c1", 100000, 1), ("a", "c2", 100001, 1), ("a", "c3", 5, 5), ("a", "c4", 5, 6)],
        "server_id string, name string, count long, index_count long")
    got = rules.collection_advice(servers, collections)
    assert rows(got, "server_id", "category", "message") == [
        ("a", "Indexes", "Collection 'c4' has 6 indexes. Review for unused indexes."),
        ("a", "Indexes", "Large collection 'c2' (100001 docs) has minimal indexing."),
        ("b", "Connections", "High connection usage (81.0%). Consider connection pooling."),
        ("b", "Profiling", "Database profiling is disabled. Enable with db.setProfilingLevel(1, {slowms: 100})."),
    ]


def test_settings_advice(spark, rows):
    settings = spark.createDataFrame(
        [("a", "WAL", 1, -2000), ("b", "delete", 2, -1999), ("c", "WAL", 0, 2000)],
        "server_id string, journal_mode string, synchronous int, cache_size int")
    assert rows(rules.settings_advice(settings), "server_id", "setting") == [
        ("b", "cache_size=-10000"), ("b", "journal_mode=WAL"), ("b", "synchronous=NORMAL")]


def test_unindexed_needs_more_than_the_limit(spark, rows):
    counts = spark.createDataFrame([("a", 1000), ("b", 1001), ("c", 5000)], "table string, row_count long")
    indexes = spark.createDataFrame([("c",), ("c",)], "table string")
    assert rows(rules.unindexed_large_tables(counts, indexes), "table", "reason") == [("b", "Table b has 1001 rows but no indexes")]


@pytest.mark.parametrize("metric,average,alert", [
    ("CPU Percentage", 80.0, []), ("CPU Percentage", 80.01, ["HIGH CPU USAGE detected: 80.01% average"]),
    ("DTU Percentage", 95.0, ["HIGH DTU USAGE detected: 95.00% average"]), ("Storage Percentage", 90.0, []),
    ("Storage Percentage", 90.5, ["HIGH STORAGE USAGE detected: 90.50% average"]), ("Other", 100.0, [])])
def test_resource_alerts(spark, metric, average, alert):
    metrics = spark.createDataFrame([("r", metric, average)], "resource string, metric string, average double")
    assert [r.message for r in rules.resource_alerts(metrics).collect()] == alert


def test_config_assessment(spark, rows):
    settings = spark.createDataFrame(
        [("a", "binlog_format", "ROW"), ("a", "sync_binlog", "0"), ("a", "gtid_mode", "ON"), ("b", "sync_binlog", "5")],
        "server_id string, name string, value string")
    got = rules.config_assessment(settings, ["server_id"])
    words = [(r.server_id, r.recommendation_type, r.assessment.split(" ")[0], r.current_value) for r in got.collect()]
    assert sorted(words, key=str) == [
        ("a", "Binlog_Format_Check", "OPTIMAL", "ROW"), ("a", "GTID_Mode_Check", "EXCELLENT", "ON"),
        ("a", "Sync_Binlog_Check", "RISKY", "0"), ("b", "Binlog_Format_Check", "SUBOPTIMAL", None),
        ("b", "GTID_Mode_Check", "RECOMMENDED", None), ("b", "Sync_Binlog_Check", "SUBOPTIMAL", "5")]


REPLICA_DDL = ("server_id string, channel_name string, slave_io_running string, slave_sql_running string, "
               "seconds_behind_master long, last_io_errno int, last_sql_errno int")


def test_replication_summary_is_strict_about_null(spark):
    replicas = spark.createDataFrame([
        ("ok", "", "Yes", "Yes", 0, 0, 0), ("stopped", "", "Yes", "No", None, 0, 1062), ("unknown", "", None, None, 61, 0, 0),
        ("named", "ch", "Yes", "Yes", 0, 0, 0)], REPLICA_DDL)
    got = {(r.server_id, r.check_name): r.status for r in aggregates.replication_summary(replicas, ["server_id"]).collect()}
    assert got == {
        ("ok", "Overall_Replication_Health"): "HEALTHY", ("ok", "Replication_Lag_Status"): "SYNCHRONIZED", ("ok", "Replication_Errors"): "NO_ERRORS",
        ("stopped", "Overall_Replication_Health"): "UNHEALTHY", ("stopped", "Replication_Lag_Status"): "REPLICATION_STOPPED",
        ("stopped", "Replication_Errors"): "ERRORS_PRESENT",
        ("unknown", "Overall_Replication_Health"): "NOT_A_SLAVE", ("unknown", "Replication_Lag_Status"): "HIGH_LAG", ("unknown", "Replication_Errors"): "NO_ERRORS",
        ("named", "Overall_Replication_Health"): "NOT_A_SLAVE", ("named", "Replication_Lag_Status"): "REPLICATION_STOPPED",
        ("named", "Replication_Errors"): "NOT_APPLICABLE"}


def test_replication_summary_of_nothing(spark):
    got = aggregates.replication_summary(spark.createDataFrame([], REPLICA_DDL))
    assert [r.details for r in got.collect()] == [
        "This server is not configured as a replication slave", "-1 seconds behind master", "Not a slave server"]


def test_first_rule_of_a_group_wins_and_null_does_not_fire(spark):
    df = spark.createDataFrame([(1, 95), (2, 80), (3, None)], "id int, v int")
    found = rules.apply_rules(df, [
        rules.Rule(F.col("v") > 90, "CRITICAL", "c", "m", "r", "g"), rules.Rule(F.col("v") > 70, "WARNING", "c", "m", "r", "g")], ["id"])
    assert {(r.id, r.severity) for r in found.collect()} == {(1, "CRITICAL"), (2, "WARNING")}


def test_rollup_status(spark, rows):
    found = spark.createDataFrame([("a", "INFO"), ("b", "INFO"), ("b", "WARNING")], "s string, severity string")
    assert rows(aggregates.rollup_status(found, ["s"]), "s", "findings", "warning", "status") == [
        ("a", 1, 0, "HEALTHY"), ("b", 2, 1, "ISSUES_FOUND")]


def test_catalog_triage_leaves_out_heaps_disabled_and_system(spark, rows):
    stats = spark.createDataFrame([(1, 0, 50.0, 5000), (1, 1, 50.0, 5000), (1, 2, 50.0, 999), (1, 3, 50.0, 1000), (2, 1, 50.0, 5000)],
                                  "object_id long, index_id int, avg_fragmentation_in_percent double, page_count long")
    indexes = spark.createDataFrame([(1, 0, "heap", False), (1, 1, "i1", False), (1, 2, "i2", False), (1, 3, "i3", True), (2, 1, "sys", False)],
                                    "object_id long, index_id int, name string, is_disabled boolean")
    tables = spark.createDataFrame([(1, "t", 1, False), (2, "s", 1, True)], "object_id long, name string, schema_id int, is_ms_shipped boolean")
    schemas = spark.createDataFrame([(1, "dbo")], "schema_id int, name string")
    got = rules.triage_catalog(stats, indexes, tables, schemas)
    assert rows(got, "schema_name", "table_name", "index_name", "operation") == [("dbo", "t", "i1", "REBUILD")]
