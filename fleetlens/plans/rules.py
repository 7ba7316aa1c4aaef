"""Health rules on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import rules as op
from ..operators.aggregates import hourly_metrics
from .registry import EVENTS_AS_OF, plan
from .shapes import TRIAGE_SQL, cents, order_fragmentation, triage


@plan("i00_apply_rules", """
SELECT c_custkey, CASE WHEN c_acctbal < 100 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Balance' AS category,
       'Balance is ' || CAST(floor(c_acctbal) AS BIGINT) AS message, 'Top up' AS recommendation FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT c_custkey, 'INFO', 'Segment', 'Machinery', 'None' FROM customer WHERE c_mktsegment = 'MACHINERY'
UNION ALL SELECT c_custkey, 'INFO', 'General', 'All health checks passed', 'Continue monitoring regularly' FROM customer WHERE NOT (c_acctbal < 1000) AND c_mktsegment <> 'MACHINERY'
""")
def apply_rules(t):
    balance = F.col("c_acctbal")
    message = F.concat(F.lit("Balance is "), F.floor(balance).cast("string"))
    return op.apply_rules(t.customer, [
        op.Rule(balance < 100, "CRITICAL", "Balance", message, "Top up", "balance"),
        op.Rule(balance < 1000, "WARNING", "Balance", message, "Top up", "balance"),
        op.Rule(F.col("c_mktsegment") == "MACHINERY", "INFO", "Segment", "Machinery", "None"),
    ], ["c_custkey"], passed=True)


@plan("i01_cache_health", """
WITH m AS (SELECT s_suppkey AS server_id, CAST(round(s_acctbal * 100) AS BIGINT) AS used, CASE WHEN s_nationkey % 5 = 0 THEN 0 ELSE 900000 END AS cap,
  s_nationkey / 10.0::DOUBLE AS ratio, s_suppkey % 7 AS hits, s_suppkey % 3 AS misses, s_suppkey % 4 AS evicted, s_nationkey % 2 AS rejected FROM supplier),
r AS (SELECT *, used::DOUBLE * 100 / nullif(cap, 0) AS pct, hits::DOUBLE * 100 / nullif(hits + misses, 0) AS hit FROM m),
f AS (
SELECT server_id, CASE WHEN pct > 90 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Memory' AS category, CASE WHEN pct > 90 THEN 'Consider increasing maxmemory or implementing eviction policy' ELSE 'Plan for memory optimization or scaling' END AS recommendation FROM r WHERE pct > 75
UNION ALL SELECT server_id, 'WARNING', 'Memory', 'Consider restarting Redis or using memory defragmentation' FROM r WHERE ratio > 1.5
UNION ALL SELECT server_id, 'WARNING', 'Performance', 'Review caching strategy and TTL settings' FROM r WHERE hit < 80
UNION ALL SELECT server_id, 'INFO', 'Memory', 'Monitor memory usage and consider increasing maxmemory' FROM r WHERE evicted > 0
UNION ALL SELECT server_id, 'WARNING', 'Connections', 'Check maxclients setting and connection pool configuration' FROM r WHERE rejected > 0)
SELECT * FROM f UNION ALL SELECT server_id, 'INFO', 'General', 'Continue monitoring regularly' FROM r WHERE server_id NOT IN (SELECT server_id FROM f)
""")
def cache_health(t):
    stats = t.supplier.select(
        F.col("s_suppkey").alias("server_id"), cents("s_acctbal").alias("used_memory"),
        F.when(F.col("s_nationkey") % 5 == 0, 0).otherwise(900000).alias("maxmemory"),
        (F.col("s_nationkey") / 10.0).alias("mem_fragmentation_ratio"), (F.col("s_suppkey") % 7).alias("keyspace_hits"),
        (F.col("s_suppkey") % 3).alias("keyspace_misses"), (F.col("s_suppkey") % 4).alias("evicted_keys"),
        (F.col("s_nationkey") % 2).alias("rejected_connections"))
    return op.cache_health(stats).drop("message")


@plan("i02_cluster_health", """
SELECT n_name AS cluster_name, CASE WHEN n_regionkey <> 1 THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Cluster Health' AS category,
  CASE WHEN n_regionkey <> 1 THEN 'Cluster status is RED - immediate attention required' ELSE 'Cluster status is YELLOW - some replicas are unassigned' END AS message,
  CASE WHEN n_regionkey <> 1 THEN 'Check for unassigned shards and node failures' ELSE 'Check shard allocation and node capacity' END AS recommendation
FROM nation WHERE n_regionkey <> 2
UNION ALL SELECT n_name, 'WARNING', 'Shard Allocation', n_regionkey || ' unassigned shards found', 'Check node capacity and allocation settings' FROM nation WHERE n_regionkey > 0
UNION ALL SELECT 'c' || c_nationkey, 'INFO', 'Index Management', 'Large index detected: ' || c_name || ' (' || c_custkey || '.0 GB)', 'Consider index lifecycle management or archival'
FROM customer WHERE c_custkey > 50 AND c_custkey < 1000
UNION ALL SELECT 'c' || c_nationkey, 'INFO', 'Index Management', 'Large index detected: ' || c_name || ' (' || printf('%.1f', floor(c_custkey / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' TB)', 'Consider index lifecycle management or archival'
FROM customer WHERE c_custkey >= 1024
UNION ALL SELECT 'c' || c_nationkey, 'INFO', 'Index Management', 'Large index detected: ' || c_name || ' (' || c_custkey || '.0 GB)', 'Consider index lifecycle management or archival'
FROM customer WHERE c_custkey >= 1000 AND c_custkey < 1024
""")
def cluster_health(t):
    status = bands.decode("n_regionkey", {0: "red", 1: "yellow", 2: "green"})
    clusters = t.nation.select(F.col("n_name").alias("cluster_name"), status.alias("status"),
                               F.col("n_regionkey").alias("unassigned_shards"))
    objects = t.customer.select(F.concat(F.lit("c"), "c_nationkey").alias("cluster_name"), F.col("c_name").alias("name"),
                                (F.col("c_custkey") * F.lit(1024 ** 3)).alias("store_size_bytes"))
    return op.cluster_health(clusters, objects)


@plan("i03_collection_advice", """
SELECT n_nationkey AS server_id, 'WARNING' AS severity, 'Connections' AS category FROM nation WHERE n_nationkey * 100.0 / (n_nationkey + n_regionkey + 1) > 80
UNION ALL SELECT n_nationkey, 'INFO', 'Profiling' FROM nation WHERE n_regionkey = 0
UNION ALL SELECT l_suppkey, 'INFO', 'Indexes' FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING count(DISTINCT l_returnflag || l_linestatus) > 5
UNION ALL SELECT l_suppkey, 'WARNING', 'Indexes' FROM lineitem GROUP BY l_suppkey, l_linenumber HAVING sum(l_orderkey) > 100000 AND count(DISTINCT l_returnflag || l_linestatus) <= 1
""")
def collection_advice(t):
    servers = t.nation.select(F.col("n_nationkey").cast("long").alias("server_id"), F.col("n_nationkey").alias("current"),
                              (F.col("n_regionkey") + 1).alias("available"), F.col("n_regionkey").alias("profiling_level"))
    kinds = t.lineitem.groupBy("l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus").agg(F.sum("l_orderkey").alias("n"))
    collections = kinds.groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_linenumber").cast("string").alias("name")).agg(
        F.sum("n").alias("count"), F.count("*").alias("index_count"))
    return op.collection_advice(servers, collections).select("server_id", "severity", "category")


@plan("i04_settings_advice", """
SELECT c_custkey AS server_id, 'journal_mode=WAL' AS setting, 'WAL mode provides better concurrency and performance' AS reason FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT c_custkey, 'synchronous=NORMAL', 'NORMAL synchronous mode is faster while still safe' FROM customer WHERE c_nationkey = 2
UNION ALL SELECT c_custkey, 'cache_size=-10000', 'Larger cache size (10MB) improves performance' FROM customer WHERE abs(floor(c_acctbal)) < 2000
""")
def settings_advice(t):
    settings = t.customer.select(
        F.col("c_custkey").alias("server_id"), bands.decode("c_mktsegment", {"MACHINERY": "WAL"}, "DELETE").alias("journal_mode"),
        F.col("c_nationkey").alias("synchronous"), (-F.floor("c_acctbal")).alias("cache_size"))
    return op.settings_advice(settings)


@plan("i05_unindexed_large_tables", """
SELECT 'part' || l_partkey AS "table", count(*) AS row_count, 'Table part' || l_partkey || ' has ' || count(*) || ' rows but no indexes' AS reason
FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25) GROUP BY l_partkey HAVING count(*) > 30
""")
def unindexed_large_tables(t):
    counts = t.lineitem.groupBy(F.concat(F.lit("part"), "l_partkey").alias("table")).agg(F.count("*").alias("row_count"))
    indexes = t.part.filter(F.col("p_size") < 25).select(F.concat(F.lit("part"), "p_partkey").alias("table"))
    return op.unindexed_large_tables(counts, indexes, more_than=30)


@plan("i06_resource_alerts", """
WITH h AS (SELECT user_id, date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
           FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL)
SELECT user_id, 'WARNING' AS severity, 'CPU Percentage' AS category FROM h GROUP BY user_id HAVING avg(average) > 80
""")
def resource_alerts(t):
    keyed = t.events.select("user_id", bands.decode("event_type", {"view": "CPU Percentage"}, "other").alias("metric"),
                            "ts", F.col("value").cast("decimal(12,2)").alias("value"))
    daily = hourly_metrics(keyed, EVENTS_AS_OF, keys=["user_id", "metric"], digits=None)
    return op.resource_alerts(daily, keys=["user_id"]).select("user_id", "severity", "category")


@plan("i07_config_assessment", """
WITH s AS (SELECT o_custkey AS server_id, max(CASE o_orderpriority WHEN '1-URGENT' THEN 'ROW' WHEN '2-HIGH' THEN 'MIXED' ELSE 'STATEMENT' END) FILTER (o_orderstatus = 'O') AS f,
  max(o_orderkey % 3)::VARCHAR AS b FROM orders GROUP BY o_custkey)
SELECT server_id, 'Binlog_Format_Check' AS recommendation_type, CASE f WHEN 'ROW' THEN 'OPTIMAL - Using ROW format for better consistency' WHEN 'MIXED' THEN 'ACCEPTABLE - Consider ROW format for better consistency' ELSE 'SUBOPTIMAL - Consider using ROW or MIXED format' END AS assessment, f AS current_value FROM s
UNION ALL SELECT server_id, 'Sync_Binlog_Check', CASE b WHEN '1' THEN 'OPTIMAL - Maximum durability enabled' WHEN '0' THEN 'RISKY - Consider setting sync_binlog=1 for durability' ELSE 'SUBOPTIMAL - Consider sync_binlog=1 for maximum durability' END, b FROM s
UNION ALL SELECT server_id, 'GTID_Mode_Check', 'RECOMMENDED - Consider enabling GTID mode for easier management', NULL FROM s
""")
def config_assessment(t):
    formats = t.orders.filter(F.col("o_orderstatus") == "O").select(
        F.col("o_custkey").alias("server_id"), F.lit("binlog_format").alias("name"),
        bands.decode("o_orderpriority", {"1-URGENT": "ROW", "2-HIGH": "MIXED"}, "STATEMENT").alias("value"))
    sync = t.orders.select(F.col("o_custkey").alias("server_id"), F.lit("sync_binlog").alias("name"),
                           (F.col("o_orderkey") % 3).cast("string").alias("value"))
    return op.config_assessment(formats.unionByName(sync), by=["server_id"])


def replica_rows(t):
    """Events as replica rows; some belong to a named channel, some lags are unknown."""
    return t.events.select(
        F.col("event_id").alias("server_id"),
        F.when(F.col("value") < 5, F.lit("other")).otherwise(F.lit("")).alias("channel_name"),
        bands.decode("event_type", {"click": "Waiting for master to send event", "view": "Connecting to master", "error": ""},
                     "Queueing master event").alias("slave_io_state"),
        bands.decode("event_type", {"click": "Yes", "error": "No"}).alias("slave_io_running"),
        bands.decode("event_type", {"click": "Yes", "view": "Yes", "error": "No"}, "Connecting").alias("slave_sql_running"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 10 - 5).cast("long")).alias("seconds_behind_master"),
        F.when(F.col("event_type") == "error", 2003).otherwise(0).alias("last_io_errno"),
        F.concat(F.lit("io "), "props").alias("last_io_error"),
        F.when(F.col("value") > 100, 1062).otherwise(0).alias("last_sql_errno"),
        F.col("props").alias("last_sql_error"))


@plan("i08_replica_thread_status", """
WITH r AS (SELECT event_id AS server_id, CASE event_type WHEN 'click' THEN 'Waiting for master to send event' WHEN 'view' THEN 'Connecting to master' WHEN 'error' THEN '' ELSE 'Queueing master event' END AS st,
  CASE event_type WHEN 'click' THEN 'Yes' WHEN 'error' THEN 'No' END AS io, CASE event_type WHEN 'click' THEN 'Yes' WHEN 'view' THEN 'Yes' WHEN 'error' THEN 'No' ELSE 'Connecting' END AS sq FROM events WHERE value >= 5)
SELECT server_id, 'Slave_IO_State' AS metric, CASE st WHEN 'Waiting for master to send event' THEN 'HEALTHY' WHEN 'Connecting to master' THEN 'CONNECTING' WHEN '' THEN 'STOPPED' ELSE 'CHECK_REQUIRED' END AS status, st AS details FROM r
UNION ALL SELECT server_id, 'Slave_IO_Running', CASE io WHEN 'Yes' THEN 'HEALTHY' WHEN 'No' THEN 'CRITICAL' ELSE 'WARNING' END, io FROM r
UNION ALL SELECT server_id, 'Slave_SQL_Running', CASE sq WHEN 'Yes' THEN 'HEALTHY' WHEN 'No' THEN 'CRITICAL' ELSE 'WARNING' END, sq FROM r
""")
def replica_thread_status(t):
    return op.replica_thread_status(replica_rows(t), by=["server_id"])


@plan("i09_replication_lag", """
WITH r AS (SELECT event_id AS server_id, CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10 - 5) AS BIGINT) END AS s FROM events WHERE value >= 5)
SELECT server_id, 'Seconds_Behind_Master' AS metric, CASE WHEN s IS NULL THEN 'REPLICATION_STOPPED' WHEN s = 0 THEN 'SYNCHRONIZED' WHEN s < 60 THEN 'ACCEPTABLE' WHEN s < 300 THEN 'WARNING' ELSE 'CRITICAL' END AS status,
  coalesce(s, -1) AS lag_seconds, CASE WHEN s > 0 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' ELSE 'N/A' END AS lag_formatted FROM r
""")
def replication_lag(t):
    return op.replication_lag(replica_rows(t), by=["server_id"])


@plan("i10_replication_errors", """
WITH r AS (SELECT * FROM events WHERE value >= 5)
SELECT event_id AS server_id, 'Last_IO_Error' AS error_type, CASE WHEN event_type = 'error' THEN 'ERROR_PRESENT' ELSE 'NO_ERROR' END AS status,
  CASE WHEN event_type = 'error' THEN 2003 ELSE 0 END AS error_number, left('io ' || props, 200) AS error_message FROM r
UNION ALL SELECT event_id, 'Last_SQL_Error', CASE WHEN value > 100 THEN 'ERROR_PRESENT' ELSE 'NO_ERROR' END, CASE WHEN value > 100 THEN 1062 ELSE 0 END, left(props, 200) FROM r
""")
def replication_errors(t):
    return op.replication_errors(replica_rows(t), by=["server_id"])


@plan("i11_connection_use", """
SELECT n_nationkey, c.n AS current, s.n AS available, c.n::DOUBLE * 100 / (c.n + s.n)::DOUBLE AS utilization_percent
FROM nation JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey
""")
def connection_use(t):
    customers = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("current"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("available"))
    return op.connection_use(t.nation.select("n_nationkey").join(customers, "n_nationkey").join(suppliers, "n_nationkey"))


@plan("i12_space_usage", """
WITH s AS (SELECT p_brand AS name, CAST(sum(p_size) AS BIGINT) * 1000 AS used, CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) AS cap, count(*) AS back FROM part GROUP BY p_brand)
SELECT name, used, cap, back, used / 1048576.0::DOUBLE AS used_mb, cap / 1048576.0::DOUBLE AS limit_mb, (cap - used) / 1048576.0::DOUBLE AS free_mb,
  used::DOUBLE * 100 / cap::DOUBLE AS used_percent, (cap - used)::DOUBLE * 100 / cap::DOUBLE AS free_percent, back / 1048576.0::DOUBLE AS reclaimable_mb FROM s
""")
def space_usage(t):
    areas = t.part.groupBy(F.col("p_brand").alias("name")).agg(
        (F.sum("p_size") * 1000).alias("used"), F.sum(cents("p_retailprice")).alias("cap"), F.count("*").alias("back"))
    return op.space_usage(areas, "used", "cap", "back")


@plan("i13_fragmentation_triage", f"WITH {TRIAGE_SQL} SELECT object_id, page_count, fragmentation_percent, operation, priority FROM triage")
def fragmentation_triage(t):
    return triage(t)


@plan("i14_fragmentation_level", f"""
WITH {TRIAGE_SQL} SELECT object_id, page_count, fragmentation_percent AS avg_fragmentation_in_percent,
  CASE WHEN fragmentation_percent < 5 THEN 'Good' WHEN fragmentation_percent < 30 THEN 'Moderate' ELSE 'High' END AS fragmentation_level FROM triage
""")
def fragmentation_level(t):
    return op.fragmentation_level(order_fragmentation(t), min_pages=3)
