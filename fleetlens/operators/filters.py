"""Projections, filters and predicates over telemetry."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import names
from ..functions.text import snippet
from ..functions.times import Instant, instant_like, seconds_since, span

ACTIVE = "active"


def active_sessions(sessions: DataFrame, as_of: Instant, self_pid: int | None = None,
                    by: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
    """Active sessions other than our own, longest-running first."""
    out = (
        sessions.filter(_other_active(self_pid))
        .select(
            *names(by), "pid", F.col("usename").alias("username"), "application_name",
            "client_addr", "backend_start", "state", "query_start",
            seconds_since("query_start", as_of).alias("query_seconds"),
            snippet("query", 100).alias("current_query"),
        )
    )
    return out.orderBy(F.desc_nulls_last("query_seconds")) if ordered else out


def long_running(df: DataFrame, start: str, as_of: Instant, threshold: float = 300.0,
                 inclusive: bool = False) -> DataFrame:
    """Rows running longer than ``threshold`` seconds (or at least that long)."""
    latest = instant_like(df, start, as_of) - span(threshold)
    old = F.col(start) <= latest if inclusive else F.col(start) < latest
    return df.filter(old).withColumn("elapsed_seconds", seconds_since(start, as_of))


def long_running_sessions(sessions: DataFrame, as_of: Instant, threshold: float = 300.0,
                          self_pid: int | None = None, by: Iterable[str] | None = None) -> DataFrame:
    """Active sessions past the threshold with 200 characters of their statement."""
    return (
        long_running(sessions.filter(_other_active(self_pid)), "query_start", as_of, threshold)
        .select(*names(by), "pid", "usename", "client_addr", "query_start", "elapsed_seconds",
                snippet("query", 200).alias("query_text"))
    )


def _other_active(self_pid: int | None) -> Column:
    active = F.col("state") == ACTIVE
    return active if self_pid is None else active & (F.col("pid") != self_pid)


def current_operations(ops: DataFrame, min_seconds: int | None = None) -> DataFrame:
    """Running operations that are not idle, optionally from ``min_seconds`` on."""
    kept = ops.filter(F.col("active") & (F.col("op") != "none"))
    if min_seconds is not None:
        kept = kept.filter(F.col("secs_running") >= min_seconds)
    return kept.select(
        "opid", "op", "ns", "secs_running",
        F.coalesce("client", F.lit("N/A")).alias("client"),
        snippet("command", 100, ellipsis=True).alias("command"),
    )


def exclude_system(df: DataFrame, col: str, exact: Sequence[str] = (), prefixes: Sequence[str] = (),
                   pattern: str | None = None, include_system: bool = False) -> DataFrame:
    """Drop objects by exact name, name prefix or regular expression."""
    if include_system:
        return df
    keep = F.lit(True)
    if exact:
        keep = keep & ~F.col(col).isin(*exact)
    for prefix in prefixes:
        keep = keep & ~F.col(col).startswith(prefix)
    if pattern:
        keep = keep & ~F.col(col).rlike(pattern)
    return df.filter(keep)


def pick_settings(settings: DataFrame, wanted: Sequence[str], wide: bool = False,
                  by: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
    """Named settings only, sorted by name, or one column per setting."""
    kept = settings.filter(F.col("name").isin(*wanted))
    keys = names(by)
    if wide:
        return kept.groupBy(*keys).agg(
            *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted]
        )
    out = kept.select(*keys, "name", "value")
    return out.orderBy(*keys, "name") if ordered else out


def describe_metrics(df: DataFrame, descriptions: Mapping[str, str], name: str = "name") -> DataFrame:
    """Keep the described metrics and attach their text, in one scan and with no join."""
    pairs = [F.lit(part) for item in descriptions.items() for part in item]
    return (
        df.filter(F.col(name).isin(*descriptions))
        .withColumn("description", F.element_at(F.create_map(*pairs), F.col(name)))
    )


Field = tuple[str, str, str]


def project_snapshot(df: DataFrame, fields: Sequence[Field], by: Iterable[str] | None = None) -> DataFrame:
    """Typed selection ``(output, input, type)`` of a status view, with the fleet keys ``by``."""
    return df.select(*names(by), *[F.col(source).cast(kind).alias(out) for out, source, kind in fields])


def _same_names(**fields: str) -> list[Field]:
    return [(name, name, kind) for name, kind in fields.items()]


# Column lists of the plain status views.
REPLICATION_SENDERS = _same_names(
    client_addr="string", client_hostname="string", client_port="int", state="string",
    sent_location="string", write_location="string", flush_location="string",
    replay_location="string", write_lag="double", flush_lag="double", replay_lag="double",
)
CHECKPOINTS = _same_names(
    checkpoints_timed="long", checkpoints_req="long", checkpoint_write_time="double",
    checkpoint_sync_time="double", buffers_checkpoint="long", buffers_clean="long",
    maxwritten_clean="long", buffers_backend="long", buffers_backend_fsync="long",
    buffers_alloc="long", stats_reset="timestamp",
)
REPLICA_SOURCE = [
    ("master_host", "master_host", "string"), ("master_port", "master_port", "int"),
    ("master_user", "master_user", "string"),
    ("current_master_log_file", "master_log_file", "string"),
    ("current_master_log_position", "read_master_log_pos", "long"),
]
RELAY_LOG = [
    ("current_relay_log_file", "relay_log_file", "string"),
    ("current_relay_log_position", "relay_log_pos", "long"),
    ("master_log_file_being_read", "relay_master_log_file", "string"),
    ("master_log_position_executed", "exec_master_log_pos", "long"),
]
TRANSACTION_SETS = [
    ("retrieved_gtid", "retrieved_gtid_set", "string"), ("executed_gtid", "executed_gtid_set", "string"),
]
# Settings picked by the reports.
SOURCE_SETTINGS = [
    "server_id", "log_bin", "log_bin_basename", "binlog_format", "binlog_row_image", "sync_binlog",
    "binlog_cache_size", "max_binlog_size", "expire_logs_days", "binlog_expire_logs_seconds",
    "gtid_mode", "enforce_gtid_consistency",
]
TRANSACTION_ID_SETTINGS = [
    "gtid_mode", "enforce_gtid_consistency", "gtid_executed", "gtid_purged", "gtid_owned",
]
SERVER_LIMIT_SETTINGS = ["max_memory_usage", "max_threads", "max_execution_time"]
CACHE_SETTINGS = [
    "maxmemory", "maxmemory-policy", "save", "appendonly", "appendfsync", "timeout",
    "tcp-keepalive", "maxclients", "databases", "port", "bind", "protected-mode",
]
# Metric descriptions.
LOG_CACHE_METRICS = {
    "Binlog_cache_use": "Total number of transactions that used the binary log cache",
    "Binlog_cache_disk_use": "Number of transactions that exceeded binlog_cache_size",
    "Binlog_stmt_cache_use": "Total number of statements that used the binary log statement cache",
    "Binlog_stmt_cache_disk_use": "Number of statements that exceeded binlog_stmt_cache_size",
}
REPLICA_METRICS = {
    "Slave_open_temp_tables": "Number of temp tables currently open by the slave SQL thread",
    "Slave_retried_transactions": "Total number of times slave SQL thread retried transactions",
    "Slave_running": "ON if this is a slave that is connected to a master",
}
# Filters shown as NOT_SET when empty.
REPLICATION_FILTER_DEFAULTS = {
    "replicate_do_db": "NOT_SET", "replicate_ignore_db": "NOT_SET", "replicate_do_table": "NOT_SET",
    "replicate_ignore_table": "NOT_SET", "replicate_wild_do_table": "NOT_SET",
    "replicate_wild_ignore_table": "NOT_SET",
}


def channel_status(channels: DataFrame) -> DataFrame:
    """Named replication channels with a running flag."""
    return channels.filter(F.col("channel_name") != "").select(
        "channel_name", F.col("host").alias("master_host"), F.col("port").alias("master_port"),
        F.col("user").alias("master_user"),
        F.when(F.col("service_state") == "ON", F.lit("RUNNING")).otherwise(F.lit("STOPPED")).alias("channel_status"),
    )


def channel_errors(channels: DataFrame) -> DataFrame:
    """Receiver thread state and last error of the named channels."""
    return channels.filter(F.col("channel_name") != "").select(
        "channel_name", "thread_id", F.col("service_state").alias("io_thread_state"),
        F.col("last_error_number").alias("last_io_error_number"),
        snippet("last_error_message", 100).alias("last_io_error_message"),
        F.col("last_error_timestamp").alias("last_error_time"),
    )


def connection_settings(replicas: DataFrame) -> DataFrame:
    """Source id, retry settings and encryption of the default channel."""
    return replicas.filter(F.col("channel_name") == "").select(
        "master_server_id", F.col("connect_retry").alias("connection_retry_interval"), "master_retry_count",
        F.when(F.col("master_ssl_allowed") == "Yes", F.lit("SSL_ENABLED")).otherwise(F.lit("SSL_DISABLED")).alias("ssl_status"),
    )


# Databases that take no log backup.
SYSTEM_DATABASES = ["master", "model", "msdb", "tempdb"]


def backup_eligibility(databases: DataFrame, kind: str = "LOG") -> DataFrame:
    """Whether a backup of this kind may run, and why not; the first obstacle counts."""
    reason = F.when(
        F.col("state_desc").isNull() | (F.col("state_desc") != "ONLINE"),
        F.concat(F.lit("Database is not online (Current state: "),
                 F.coalesce("state_desc", F.lit("Unknown")), F.lit(")")),
    )
    if kind == "LOG":
        reason = reason.when(
            F.col("name").isin(*SYSTEM_DATABASES),
            F.lit("Transaction log backup not supported for system database"),
        ).when(
            F.col("recovery_model_desc") == "SIMPLE",
            F.lit("Transaction log backup not available in SIMPLE recovery model"),
        )
    return databases.withColumn("reason", reason).withColumn("eligible", F.col("reason").isNull())


def write_volume(df: DataFrame) -> DataFrame:
    """Total writes of a table."""
    return df.withColumn("total_writes", F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del"))


def index_bytes(df: DataFrame) -> DataFrame:
    """Index share of a table's size: total less table."""
    return df.withColumn("index_bytes", F.col("total_bytes") - F.col("table_bytes"))
