"""Named status reports on the driver tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..operators import filters, status as op
from .registry import plan

NOISE = "unrelated"


def named_rows(t, wanted: Sequence[str]):
    """Customers as settings or metrics of their nation's server; some carry a name no report asks for."""
    pool = F.array(*[F.lit(name) for name in [*wanted, NOISE]])
    turn = (F.col("c_custkey") % (len(wanted) + 1) + 1).cast("int")
    return t.customer.select(F.col("c_nationkey").alias("server_id"), F.element_at(pool, turn).alias("name"),
                             F.col("c_name").alias("value"))


def _list(texts: Sequence[str]) -> str:
    return "[" + ", ".join(f"'{text}'" for text in texts) + "]"


def named_sql(wanted: Sequence[str]) -> str:
    size = len(wanted) + 1
    return (f"SELECT c_nationkey AS server_id, {_list(wanted)}[c_custkey % {size} + 1] AS name, c_name AS value FROM customer "
            f"WHERE c_custkey % {size} < {len(wanted)}")


def described_sql(described: dict[str, str]) -> str:
    size = len(described) + 1
    return (f"SELECT c_nationkey AS server_id, {_list(list(described))}[c_custkey % {size} + 1] AS name, c_name AS value, "
            f"{_list(list(described.values()))}[c_custkey % {size} + 1] AS description FROM customer "
            f"WHERE c_custkey % {size} < {len(described)}")


@plan("b05_source_settings", named_sql(filters.SOURCE_SETTINGS))
def source_settings(t):
    return op.source_settings(named_rows(t, filters.SOURCE_SETTINGS), ["server_id"], ordered=False)


@plan("b05_transaction_id_settings", named_sql(filters.TRANSACTION_ID_SETTINGS))
def transaction_id_settings(t):
    return op.transaction_id_settings(named_rows(t, filters.TRANSACTION_ID_SETTINGS), ["server_id"], ordered=False)


@plan("b05_cache_settings", named_sql(filters.CACHE_SETTINGS))
def cache_settings(t):
    return op.cache_settings(named_rows(t, filters.CACHE_SETTINGS), ["server_id"], ordered=False)


@plan("b05_server_limits", """
SELECT c_nationkey AS server_id, max(c_name) FILTER (c_custkey % 4 = 0) AS max_memory_usage,
  max(c_name) FILTER (c_custkey % 4 = 1) AS max_threads, max(c_name) FILTER (c_custkey % 4 = 2) AS max_execution_time
FROM customer WHERE c_custkey % 4 < 3 GROUP BY c_nationkey
""")
def server_limits(t):
    return op.server_limits(named_rows(t, filters.SERVER_LIMIT_SETTINGS), ["server_id"])


@plan("b17_log_cache_metrics", described_sql(filters.LOG_CACHE_METRICS))
def log_cache_metrics(t):
    return op.log_cache_metrics(named_rows(t, list(filters.LOG_CACHE_METRICS)), ["server_id"])


@plan("b17_replica_metrics", described_sql(filters.REPLICA_METRICS))
def replica_metrics(t):
    return op.replica_metrics(named_rows(t, list(filters.REPLICA_METRICS)), ["server_id"])


@plan("b18_replication_senders", """
SELECT s_suppkey AS server_id, '10.0.0.' || s_nationkey AS client_addr, s_name AS client_hostname, s_nationkey AS client_port,
  CASE WHEN s_suppkey % 2 = 0 THEN 'streaming' END AS state, 'a' || s_suppkey AS sent_location, 'b' || s_suppkey AS write_location,
  'c' || s_suppkey AS flush_location, 'd' || s_suppkey AS replay_location, s_nationkey * 0.25::DOUBLE AS write_lag,
  s_nationkey * 0.5::DOUBLE AS flush_lag, s_acctbal AS replay_lag FROM supplier
""")
def replication_senders(t):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    view = t.supplier.select(
        key.alias("server_id"), F.concat(F.lit("10.0.0."), nation).alias("client_addr"), F.col("s_name").alias("client_hostname"),
        nation.cast("string").alias("client_port"), F.when(key % 2 == 0, F.lit("streaming")).alias("state"),
        *[F.concat(F.lit(mark), key).alias(f"{step}_location") for mark, step in zip("abcd", ("sent", "write", "flush", "replay"), strict=True)],
        (nation * 0.25).alias("write_lag"), (nation * 0.5).alias("flush_lag"), F.col("s_acctbal").cast("string").alias("replay_lag"),
        F.lit("not shown").alias("backend_type"))
    return op.replication_senders(view, ["server_id"])


@plan("b18_checkpoints", """
SELECT o_custkey AS server_id, o_orderkey AS checkpoints_timed, o_orderkey + 1 AS checkpoints_req, o_totalprice AS checkpoint_write_time,
  o_orderkey * 0.5::DOUBLE AS checkpoint_sync_time, o_orderkey + 2 AS buffers_checkpoint, o_orderkey + 3 AS buffers_clean,
  o_orderkey + 4 AS maxwritten_clean, o_orderkey + 5 AS buffers_backend, o_orderkey + 6 AS buffers_backend_fsync,
  o_orderkey + 7 AS buffers_alloc, o_orderdate AS stats_reset FROM orders
""")
def checkpoints(t):
    key = F.col("o_orderkey")
    view = t.orders.select(
        F.col("o_custkey").alias("server_id"), key.alias("checkpoints_timed"), (key + 1).alias("checkpoints_req"),
        F.col("o_totalprice").alias("checkpoint_write_time"), (key * 0.5).alias("checkpoint_sync_time"),
        (key + 2).alias("buffers_checkpoint"), (key + 3).alias("buffers_clean"), (key + 4).alias("maxwritten_clean"),
        (key + 5).alias("buffers_backend"), (key + 6).alias("buffers_backend_fsync"), (key + 7).alias("buffers_alloc"),
        F.col("o_orderdate").alias("stats_reset"))
    return op.checkpoints(view, ["server_id"]).withColumn("stats_reset", F.col("stats_reset").cast("timestamp_ntz"))


def replicas_from_customers(t):
    """Customers as replicas; those of the first nation have a named channel."""
    nation, name = F.col("c_nationkey"), F.col("c_name")
    return t.customer.select(
        F.col("c_custkey").alias("server_id"), F.when(nation == 0, F.lit("other")).otherwise(F.lit("")).alias("channel_name"),
        F.concat(F.lit("in:"), name).alias("retrieved_gtid_set"), F.concat(F.lit("done:"), name).alias("executed_gtid_set"),
        F.when(nation % 2 == 0, name).alias("replicate_do_db"), F.when(nation % 3 == 0, F.col("c_mktsegment")).alias("replicate_wild_do_table"))


@plan("b18_transaction_sets", """
SELECT c_custkey AS server_id, 'in:' || c_name AS retrieved_gtid, 'done:' || c_name AS executed_gtid FROM customer WHERE c_nationkey <> 0
""")
def transaction_sets(t):
    return op.transaction_sets(replicas_from_customers(t), ["server_id"])


@plan("b18_replication_filters", """
SELECT c_custkey AS server_id, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE 'NOT_SET' END AS replicate_do_db,
  'NOT_SET' AS replicate_ignore_db, 'NOT_SET' AS replicate_do_table, 'NOT_SET' AS replicate_ignore_table,
  CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE 'NOT_SET' END AS replicate_wild_do_table, 'NOT_SET' AS replicate_wild_ignore_table
FROM customer WHERE c_nationkey <> 0
""")
def replication_filters(t):
    return op.replication_filters(replicas_from_customers(t), ["server_id"])
