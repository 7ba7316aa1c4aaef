"""Projections, filters and predicates on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands, numbers, sizes, text, times
from ..functions.columns import with_defaults
from ..operators import filters as op
from .registry import ORDERS_AS_OF, plan


def sessions_from_orders(t):
    """Orders as sessions: open orders are active, started on the order date."""
    return t.orders.select(
        F.col("o_orderkey").alias("pid"), F.concat(F.lit("user"), F.col("o_custkey")).alias("usename"),
        F.col("o_orderpriority").alias("application_name"), F.lit(None).cast("string").alias("client_addr"),
        F.col("o_orderdate").alias("backend_start"),
        bands.decode("o_orderstatus", {"O": "active"}, "idle").alias("state"),
        F.col("o_orderdate").alias("query_start"),
        F.concat(F.lit("order "), F.col("o_orderkey"), F.lit(" of "), F.col("o_custkey")).alias("query"),
    )


@plan("b01_active_sessions", """
SELECT o_orderkey AS pid, 'user' || o_custkey AS username, o_orderpriority AS application_name,
       CAST(NULL AS VARCHAR) AS client_addr, o_orderdate AS backend_start, 'active' AS state,
       o_orderdate AS query_start,
       CAST(epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) AS DOUBLE) AS query_seconds,
       left('order ' || o_orderkey || ' of ' || o_custkey, 100) AS current_query
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey <> 11
""")
def active_sessions(t):
    return op.active_sessions(sessions_from_orders(t), ORDERS_AS_OF, self_pid=11, ordered=False)


@plan("b02_long_running", """
SELECT o_orderkey AS pid, 'user' || o_custkey AS usename, CAST(NULL AS VARCHAR) AS client_addr,
       o_orderdate AS query_start,
       CAST(epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) AS DOUBLE) AS elapsed_seconds,
       left('order ' || o_orderkey || ' of ' || o_custkey, 200) AS query_text
FROM orders WHERE o_orderstatus = 'O' AND date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') > 365
""")
def long_running(t):
    return op.long_running_sessions(sessions_from_orders(t), ORDERS_AS_OF, threshold=365 * 86400.0)


@plan("b02_long_running_operations", """
SELECT event_id AS opid, event_type AS op, 'ns' || (user_id % 10) AS ns,
       CAST(floor(value) AS BIGINT) AS secs_running, 'N/A' AS client, left(props, 100) || '...' AS command
FROM events WHERE event_type <> 'error' AND floor(value) >= 10
""")
def long_running_operations(t):
    ops = t.events.select(
        F.col("event_id").alias("opid"),
        F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.col("event_type")).alias("op"),
        F.concat(F.lit("ns"), F.col("user_id") % 10).alias("ns"),
        F.floor("value").cast("long").alias("secs_running"), F.lit(None).cast("string").alias("client"),
        F.col("props").alias("command"), F.lit(True).alias("active"),
    )
    return op.current_operations(ops, min_seconds=10)


@plan("b03_snippet", """
SELECT doc_id, left(text, 100) AS snippet, left(text, 100) || '...' AS snippet_dots FROM documents
""")
def snippet(t):
    return t.documents.select("doc_id", text.snippet("text", 100).alias("snippet"),
                              text.snippet("text", 100, ellipsis=True).alias("snippet_dots"))


@plan("b04_exclude_system", """
SELECT n_nationkey, n_name FROM nation
WHERE n_name NOT IN ('NATION_3', 'NATION_7') AND NOT starts_with(n_name, 'NATION_1')
  AND NOT regexp_matches(n_name, '4$')
""")
def exclude_system(t):
    return op.exclude_system(t.nation, "n_name", exact=["NATION_3", "NATION_7"], prefixes=["NATION_1"],
                             pattern="4$").select("n_nationkey", "n_name")


def settings_from_events(t):
    return t.events.select(F.col("user_id").alias("server_id"), F.col("event_type").alias("name"), "value")


@plan("b05_pick_settings", """
SELECT user_id AS server_id, event_type AS name, value FROM events WHERE event_type IN ('click', 'view')
""")
def pick_settings(t):
    return op.pick_settings(settings_from_events(t), ["click", "view"], by=["server_id"], ordered=False)


@plan("b05_pick_settings_wide", """
SELECT user_id AS server_id, max(value) FILTER (event_type = 'click') AS click,
       max(value) FILTER (event_type = 'view') AS "view"
FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id
""")
def pick_settings_wide(t):
    return op.pick_settings(settings_from_events(t), ["click", "view"], wide=True, by=["server_id"])


@plan("b06_guarded_percent", """
SELECT l_orderkey, l_linenumber,
       100.0::DOUBLE * l_discount / NULLIF(l_tax, 0) AS null_on_zero,
       CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE * l_discount / NULLIF(l_tax, 0) END AS zero_on_zero
FROM lineitem
""")
def guarded_percent(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        numbers.pct("l_discount", "l_tax").alias("null_on_zero"),
        numbers.pct("l_discount", "l_tax", on_zero="zero").alias("zero_on_zero"),
    )


@plan("b07_bands", """
SELECT c_custkey,
       CASE WHEN c_acctbal IS NULL THEN 'REPLICATION_STOPPED' WHEN c_acctbal = 0 THEN 'SYNCHRONIZED'
            WHEN c_acctbal < 60 THEN 'ACCEPTABLE' WHEN c_acctbal < 300 THEN 'WARNING' ELSE 'CRITICAL' END AS lag_band,
       CASE WHEN c_acctbal >= 30 THEN 1 WHEN c_acctbal >= 5 THEN 2 ELSE 3 END AS priority
FROM customer
""")
def band_labels(t):
    return t.customer.select(
        "c_custkey",
        bands.band("c_acctbal", bands.LAG_DETAIL, "CRITICAL", bands.LAG_STOPPED).alias("lag_band"),
        bands.band("c_acctbal", bands.FRAGMENTATION_PRIORITY, 3).alias("priority"),
    )


@plan("b07_decode", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Full' WHEN '2-HIGH' THEN 'Differential'
       ELSE 'Transaction Log' END AS backup_type FROM orders
""")
def decode(t):
    return t.orders.select("o_orderkey", bands.decode(
        bands.decode("o_orderpriority", {"1-URGENT": "D", "2-HIGH": "I"}, "L"), bands.BACKUP_KINDS,
    ).alias("backup_type"))


@plan("b08_defaults", """
SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal) AS BIGINT) END, -1) AS lag_seconds,
       coalesce(nullif(c_mktsegment, 'MACHINERY'), 'NOT_SET') AS segment, 'Unknown' AS version
FROM customer
""")
def defaults(t):
    raw = t.customer.select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.floor("c_acctbal").cast("long")).alias("lag_seconds"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("segment"),
    )
    return with_defaults(raw, {"lag_seconds": -1, "segment": "NOT_SET", "version": "Unknown"})


@plan("b09_format_bytes", """
WITH s AS (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * p_size * p_size AS n FROM part)
SELECT p_partkey, n / 1048576.0::DOUBLE AS size_mb,
       CASE WHEN n < 1024 THEN 0 WHEN n < 1048576 THEN 1 WHEN n < 1073741824 THEN 2 ELSE 3 END AS unit_power,
       CASE WHEN n < 1024 THEN n::VARCHAR || '.0 B'
            WHEN n < 1048576 THEN printf('%.1f', floor(n / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB'
            WHEN n < 1073741824 THEN printf('%.1f', floor(n / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB'
            ELSE printf('%.1f', floor(n / 1073741824.0::DOUBLE * 10 + 0.5) / 10) || ' GB' END AS size_text
FROM s
""")
def format_bytes(t):
    size = (F.round(F.col("p_retailprice") * 100).cast("long") * F.col("p_size") * F.col("p_size"))
    shown = t.part.select("p_partkey", size.alias("n"))
    return shown.select(
        "p_partkey", sizes.to_mb("n").alias("size_mb"),
        bands.band("n", [("<", 1024, 0), ("<", 1024 ** 2, 1), ("<", 1024 ** 3, 2)], 3).alias("unit_power"),
        sizes.format_bytes("n").alias("size_text"),
    )


@plan("b09_format_bytes_iec", """
WITH s AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, n / 1073741824.0::DOUBLE AS size_gb,
  CASE WHEN n <= 1023 * 1024 THEN CASE WHEN ceil(n / 1024.0::DOUBLE * 10) < 100 THEN printf('%.1fKiB', ceil(n / 1024.0::DOUBLE * 10) / 10) ELSE CAST(ceil(n / 1024.0::DOUBLE) AS BIGINT) || 'KiB' END
       ELSE CASE WHEN ceil(n / 1048576.0::DOUBLE * 10) < 100 THEN printf('%.1fMiB', ceil(n / 1048576.0::DOUBLE * 10) / 10) ELSE CAST(ceil(n / 1048576.0::DOUBLE) AS BIGINT) || 'MiB' END END AS size_text
FROM s
""")
def format_bytes_iec(t):
    sized = t.orders.select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("n"))
    return sized.select("o_orderkey", sizes.to_gb("n").alias("size_gb"), sizes.format_bytes("n", "iec").alias("size_text"))


@plan("b10_parse_bytes", """
SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) * 1024.0::DOUBLE AS kib_bytes,
       p_size * 1048576.0::DOUBLE AS mb_bytes, CAST(NULL AS DOUBLE) AS unknown_bytes
FROM part
""")
def parse_bytes(t):
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    return t.part.select(
        "p_partkey", sizes.parse_bytes(F.concat(cents, F.lit("KiB"))).alias("kib_bytes"),
        sizes.parse_bytes(F.concat(F.col("p_size"), F.lit(".0 MB"))).alias("mb_bytes"),
        sizes.parse_bytes(F.concat(F.lit("Unknown"), F.col("p_size"))).alias("unknown_bytes"),
    )


@plan("b11_format_duration", """
WITH s AS (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-02', date_trunc('second', ts)) AS n FROM events)
SELECT event_id, CASE WHEN n > 0 THEN (n // 3600) || 'h ' || (n % 3600 // 60) || 'm ' || (n % 60) || 's' ELSE 'N/A' END AS lag_text,
       CAST(floor(n / 86400.0) AS BIGINT) AS days, CAST(floor(n / 3600.0) AS BIGINT) AS hours
FROM s
""")
def format_duration(t):
    n = times.elapsed(F.lit("2024-01-02"), "ts")
    return t.events.select("event_id", times.format_duration(n).alias("lag_text"),
                           times.whole_days(n).alias("days"), times.whole_hours(n).alias("hours"))


@plan("b12_elapsed", """
SELECT l_orderkey, l_linenumber, l_partkey, date_diff('second', o_orderdate, l_shipdate) AS seconds,
       date_diff('minute', o_orderdate, l_shipdate) AS minutes,
       CAST(epoch(l_shipdate) - epoch(o_orderdate) AS DOUBLE) AS exact_seconds
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""")
def elapsed(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    dates = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return lines.join(dates, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        times.elapsed("o_orderdate", "l_shipdate").alias("seconds"),
        times.elapsed("o_orderdate", "l_shipdate", "minute").alias("minutes"),
        times.elapsed("o_orderdate", "l_shipdate", "exact").alias("exact_seconds"),
    )


@plan("b13_qualified_name", """
SELECT n_nationkey, r_name || '.' || n_name AS object_name, r_name || '.' || nullif(n_name, 'NATION_1') AS nullable_name
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def qualified_name(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("n_nationkey", text.qualified_name("r_name", "n_name").alias("object_name"),
                         text.qualified_name("r_name", F.nullif("n_name", F.lit("NATION_1"))).alias("nullable_name"))


@plan("b14_match_glob", """
SELECT p_partkey, p_name FROM part WHERE p_name GLOB 'red *' OR p_name GLOB '*r?ng'
""")
def match_glob(t):
    return text.match_glob(t.part, "p_name", "red *,*r?ng").select("p_partkey", "p_name")


@plan("b15_parse_when", """
SELECT event_id, date_trunc('second', ts) AS from_epoch, ts AS from_micros, ts AS from_iso,
       date_trunc('second', ts) AS from_name,
       CASE WHEN user_id % 2 = 0 THEN 'Never' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown
FROM events
""")
def parse_when(t):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    name = F.concat(F.lit("db_backup_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".sql.gz"))
    saved = F.when(F.col("user_id") % 2 == 0, F.lit(0)).otherwise(times.seconds("ts"))
    return t.events.select(
        "event_id",
        times.parse_when(times.seconds("ts"), "epoch").cast("timestamp_ntz").alias("from_epoch"),
        times.parse_when(times.micros("ts"), "epoch_us").cast("timestamp_ntz").alias("from_micros"),
        times.parse_when(iso, "iso").cast("timestamp_ntz").alias("from_iso"),
        times.parse_when(name, "name").cast("timestamp_ntz").alias("from_name"),
        times.epoch_or_never(saved).alias("shown"),
    )


@plan("b16_derived_volumes", """
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) + l_linenumber + 1 AS total_writes,
       CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(l_quantity AS BIGINT) AS index_bytes
FROM lineitem
""")
def derived_volumes(t):
    tables = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("long").alias("n_tup_ins"),
        F.col("l_linenumber").cast("long").alias("n_tup_upd"), F.lit(1).alias("n_tup_del"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("total_bytes"),
        F.col("l_quantity").cast("long").alias("table_bytes"),
    )
    return op.index_bytes(op.write_volume(tables)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "total_writes", "index_bytes")


@plan("b17_describe_metrics", """
SELECT event_type AS name, count(*) AS value,
       CASE event_type WHEN 'click' THEN 'Number of clicks' ELSE 'Number of errors' END AS description
FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type
""")
def describe_metrics(t):
    counts = t.events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
    return op.describe_metrics(counts, {"click": "Number of clicks", "error": "Number of errors"})


@plan("b18_project_snapshot", """
SELECT 'host' || s_suppkey AS master_host, CAST(s_nationkey AS INTEGER) AS master_port, s_name AS master_user,
       'bin.' || s_nationkey AS current_master_log_file, CAST(round(s_acctbal * 100) AS BIGINT) AS current_master_log_position
FROM supplier
""")
def project_snapshot(t):
    replicas = t.supplier.select(
        F.concat(F.lit("host"), F.col("s_suppkey")).alias("master_host"), F.col("s_nationkey").alias("master_port"),
        F.col("s_name").alias("master_user"), F.concat(F.lit("bin."), F.col("s_nationkey")).alias("master_log_file"),
        F.round(F.col("s_acctbal") * 100).cast("long").alias("read_master_log_pos"),
    )
    return op.project_snapshot(replicas, op.REPLICA_SOURCE)


@plan("b18_relay_log", """
SELECT 'relay.' || s_nationkey AS current_relay_log_file, s_suppkey AS current_relay_log_position, 'bin.' || s_nationkey AS master_log_file_being_read, s_suppkey * 2 AS master_log_position_executed FROM supplier
""")
def relay_log(t):
    return op.project_snapshot(t.supplier.select(
        F.concat(F.lit("relay."), "s_nationkey").alias("relay_log_file"), F.col("s_suppkey").alias("relay_log_pos"),
        F.concat(F.lit("bin."), "s_nationkey").alias("relay_master_log_file"), (F.col("s_suppkey") * 2).alias("exec_master_log_pos"),
    ), op.RELAY_LOG)


@plan("b18_channel_errors", """
SELECT 'ch' || doc_id AS channel_name, n_chars AS thread_id, lang AS io_thread_state, n_chars % 3 AS last_io_error_number,
  left(text, 100) AS last_io_error_message, TIMESTAMP '2024-01-01' AS last_error_time
FROM documents WHERE source <> 'src0'
""")
def channel_errors(t):
    return op.channel_errors(t.documents.select(
        F.when(F.col("source") == "src0", F.lit("")).otherwise(F.concat(F.lit("ch"), "doc_id")).alias("channel_name"),
        F.col("n_chars").alias("thread_id"), F.col("lang").alias("service_state"),
        (F.col("n_chars") % 3).alias("last_error_number"), F.col("text").alias("last_error_message"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("last_error_timestamp")))


@plan("b18_connection_settings", """
SELECT c_custkey AS master_server_id, 60 AS connection_retry_interval, c_nationkey AS master_retry_count,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SSL_ENABLED' ELSE 'SSL_DISABLED' END AS ssl_status
FROM customer WHERE c_nationkey <> 0
""")
def connection_settings(t):
    return op.connection_settings(t.customer.select(
        F.when(F.col("c_nationkey") == 0, F.lit("other")).otherwise(F.lit("")).alias("channel_name"),
        F.col("c_custkey").alias("master_server_id"), F.lit(60).alias("connect_retry"), F.col("c_nationkey").alias("master_retry_count"),
        bands.decode("c_mktsegment", {"MACHINERY": "Yes"}, "No").alias("master_ssl_allowed")))


@plan("b18_channel_status", """
SELECT n_name AS channel_name, 'host' || n_regionkey AS master_host, n_nationkey AS master_port,
       CAST(NULL AS VARCHAR) AS master_user, CASE WHEN n_regionkey = 1 THEN 'RUNNING' ELSE 'STOPPED' END AS channel_status
FROM nation WHERE n_nationkey > 0
""")
def channel_status(t):
    channels = t.nation.select(
        F.when(F.col("n_nationkey") == 0, F.lit("")).otherwise(F.col("n_name")).alias("channel_name"),
        F.concat(F.lit("host"), F.col("n_regionkey")).alias("host"), F.col("n_nationkey").alias("port"),
        F.lit(None).cast("string").alias("user"),
        F.when(F.col("n_regionkey") == 1, F.lit("ON")).otherwise(F.lit("OFF")).alias("service_state"),
    )
    return op.channel_status(channels)


@plan("b19_backup_eligibility", """
SELECT o_orderkey, o_orderstatus IS NOT NULL AND o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' AS eligible,
       CASE WHEN o_orderstatus = 'F' THEN 'Database is not online (Current state: OFFLINE)'
            WHEN o_orderpriority = '5-LOW' THEN 'Transaction log backup not available in SIMPLE recovery model' END AS reason
FROM orders
""")
def backup_eligibility(t):
    databases = t.orders.select(
        "o_orderkey", F.concat(F.lit("db"), F.col("o_custkey")).alias("name"),
        bands.decode("o_orderstatus", {"F": "OFFLINE"}, "ONLINE").alias("state_desc"),
        bands.decode("o_orderpriority", {"5-LOW": "SIMPLE"}, "FULL").alias("recovery_model_desc"),
    )
    return op.backup_eligibility(databases, "LOG").select("o_orderkey", "eligible", "reason")
