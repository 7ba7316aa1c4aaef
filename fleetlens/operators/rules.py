"""Health rules: metrics in, findings out."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, sizes
from ..functions.columns import names
from ..functions.numbers import pct, share_of
from ..functions.text import snippet
from ..functions.times import format_duration
from .joins import resolve_objects


@dataclass(frozen=True)
class Rule:
    """A condition that yields a finding. Of the rules of one ``group`` the first that holds counts."""

    condition: Column
    severity: str
    category: str
    message: Column | str
    recommendation: str
    group: str | None = None


# The finding of a clean bill of health.
PASSED = ("INFO", "General", "All health checks passed", "Continue monitoring regularly")


def _finding(severity: str, category: str, message: Column | str, recommendation: str) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"),
                    text.alias("message"), F.lit(recommendation).alias("recommendation"))


def apply_rules(df: DataFrame, rules: Sequence[Rule], keys: Iterable[str], passed: bool = False) -> DataFrame:
    """Findings of every row in one pass; works on streams too.

    A NULL condition does not fire.  With ``passed``, a row without findings
    yields the one that says so.
    """
    grouped: dict[object, list[Rule]] = {}
    for i, rule in enumerate(rules):
        grouped.setdefault(rule.group or i, []).append(rule)
    slots = []
    for members in grouped.values():
        slot = None
        for rule in members:
            made = _finding(rule.severity, rule.category, rule.message, rule.recommendation)
            slot = F.when(rule.condition, made) if slot is None else slot.when(rule.condition, made)
        slots.append(slot)
    fired = F.filter(F.array(*slots), lambda finding: finding.isNotNull())
    if passed:
        fired = F.when(F.size(fired) > 0, fired).otherwise(F.array(_finding(*PASSED)))
    return df.select(*names(keys), F.inline(fired))


def cache_ratios(df: DataFrame) -> DataFrame:
    """Memory use and hit ratio in percent; NULL without a limit or without traffic."""
    return df.withColumns({
        "memory_usage_percent": pct("used_memory", "maxmemory"),
        "hit_ratio_percent": share_of("keyspace_hits", "keyspace_misses"),
    })


def cache_health(df: DataFrame, keys: Iterable[str] = ("server_id",)) -> DataFrame:
    """Findings of cache servers."""
    used, ratio, hits = F.col("memory_usage_percent"), F.col("mem_fragmentation_ratio"), F.col("hit_ratio_percent")
    evicted, rejected = F.col("evicted_keys"), F.col("rejected_connections")
    # Limits and texts of the cache rules.
    rules = [
        Rule(used > 90, "CRITICAL", "Memory", F.format_string("Memory usage is %.1f%% - critically high", used),
             "Consider increasing maxmemory or implementing eviction policy", "memory"),
        Rule(used > 75, "WARNING", "Memory", F.format_string("Memory usage is %.1f%% - monitor closely", used),
             "Plan for memory optimization or scaling", "memory"),
        Rule(ratio > 1.5, "WARNING", "Memory", F.format_string("Memory fragmentation ratio is %.2f", ratio),
             "Consider restarting Redis or using memory defragmentation"),
        Rule(hits < 80, "WARNING", "Performance", F.format_string("Cache hit ratio is %.1f%% - low efficiency", hits),
             "Review caching strategy and TTL settings"),
        Rule(evicted > 0, "INFO", "Memory", F.concat(evicted.cast("string"), F.lit(" keys have been evicted")),
             "Monitor memory usage and consider increasing maxmemory"),
        Rule(rejected > 0, "WARNING", "Connections",
             F.concat(rejected.cast("string"), F.lit(" connections have been rejected")),
             "Check maxclients setting and connection pool configuration"),
    ]
    return apply_rules(cache_ratios(df), rules, keys, passed=True)


# Fixed value: size from which a search index counts as large.
LARGE_INDEX_BYTES = 50 * 1024 ** 3


def cluster_health(clusters: DataFrame, objects: DataFrame, keys: Iterable[str] = ("cluster_name",)) -> DataFrame:
    """Findings of search clusters and their indices; an unknown status counts as red."""
    status = F.coalesce("status", F.lit("red"))
    unassigned = F.col("unassigned_shards")
    # Texts of the cluster rules.
    cluster_rules = [
        Rule(status == "red", "CRITICAL", "Cluster Health", "Cluster status is RED - immediate attention required",
             "Check for unassigned shards and node failures", "status"),
        Rule(status == "yellow", "WARNING", "Cluster Health", "Cluster status is YELLOW - some replicas are unassigned",
             "Check shard allocation and node capacity", "status"),
        Rule(unassigned > 0, "WARNING", "Shard Allocation",
             F.concat(unassigned.cast("string"), F.lit(" unassigned shards found")),
             "Check node capacity and allocation settings"),
    ]
    size = F.col("store_size_bytes")
    index_rules = [Rule(
        size > LARGE_INDEX_BYTES, "INFO", "Index Management",
        F.concat(F.lit("Large index detected: "), F.col("name"), F.lit(" ("), sizes.format_bytes(size), F.lit(")")),
        "Consider index lifecycle management or archival")]
    return apply_rules(clusters, cluster_rules, keys).unionByName(apply_rules(objects, index_rules, keys))


def connection_use(df: DataFrame) -> DataFrame:
    """Percent of connections in use."""
    return df.withColumn("utilization_percent", share_of("current", "available"))


# Limits of the document-store advice.
MAX_INDEXES, LARGE_COLLECTION = 5, 100_000


def collection_advice(servers: DataFrame, collections: DataFrame, keys: Iterable[str] = ("server_id",),
                      max_indexes: int = MAX_INDEXES, large: int = LARGE_COLLECTION) -> DataFrame:
    """Advice for document stores: connections, too many or too few indexes, profiling.

    ``collections`` carries ``index_count`` per collection.
    """
    used = F.col("utilization_percent")
    # Texts of the advice.
    server_rules = [
        Rule(used > 80, "WARNING", "Connections",
             F.format_string("High connection usage (%.1f%%). Consider connection pooling.", used), "Use connection pooling"),
        Rule(F.col("profiling_level") == 0, "INFO", "Profiling",
             "Database profiling is disabled. Enable with db.setProfilingLevel(1, {slowms: 100}).", "Enable profiling"),
    ]
    many = F.concat(F.lit("Collection '"), F.col("name"), F.lit("' has "), F.col("index_count").cast("string"),
                    F.lit(" indexes. Review for unused indexes."))
    few = F.concat(F.lit("Large collection '"), F.col("name"), F.lit("' ("), F.col("count").cast("string"),
                   F.lit(" docs) has minimal indexing."))
    collection_rules = [
        Rule(F.col("index_count") > max_indexes, "INFO", "Indexes", many, "Drop indexes that are not used"),
        Rule((F.col("count") > large) & (F.col("index_count") <= 1), "WARNING", "Indexes", few,
             "Add indexes for frequent queries"),
    ]
    return apply_rules(connection_use(servers), server_rules, keys).unionByName(
        apply_rules(collections, collection_rules, keys))


def settings_advice(settings: DataFrame, keys: Iterable[str] = ("server_id",)) -> DataFrame:
    """Suggested settings of embedded databases, one row per setting to change."""
    def suggest(condition: Column, setting: str, reason: str) -> Column:
        return F.when(condition, F.struct(F.lit(setting).alias("setting"), F.lit(reason).alias("reason")))
    # Limits and texts of the settings advice.
    advice = F.array(
        suggest(F.col("journal_mode") != "WAL", "journal_mode=WAL", "WAL mode provides better concurrency and performance"),
        suggest(F.col("synchronous") == 2, "synchronous=NORMAL", "NORMAL synchronous mode is faster while still safe"),
        suggest(F.abs("cache_size") < 2000, "cache_size=-10000", "Larger cache size (10MB) improves performance"),
    )
    return settings.select(*names(keys), F.inline(F.filter(advice, lambda item: item.isNotNull())))


def unindexed_large_tables(counts: DataFrame, indexes: DataFrame, more_than: int = 1000,
                           by: Iterable[str] | None = None) -> DataFrame:
    """Tables with many rows and no index at all."""
    keys = [*names(by), "table"]
    return counts.filter(F.col("row_count") > more_than).join(indexes.select(*keys), keys, "left_anti").withColumn(
        "reason", F.concat(F.lit("Table "), "table", F.lit(" has "), F.col("row_count").cast("string"),
                           F.lit(" rows but no indexes")))


# Limits of the resource alerts, on averages of the last day.
RESOURCE_LIMITS = [
    ("CPU Percentage", 80.0, "HIGH CPU USAGE"),
    ("DTU Percentage", 80.0, "HIGH DTU USAGE"),
    ("Storage Percentage", 90.0, "HIGH STORAGE USAGE"),
]


def resource_alerts(metrics: DataFrame, keys: Iterable[str] = ("resource",),
                    limits: Sequence[tuple[str, float, str]] = RESOURCE_LIMITS) -> DataFrame:
    """Alerts on daily averages of hourly metrics."""
    rules = [
        Rule((F.col("metric") == metric) & (F.col("average") > limit), "WARNING", metric,
             F.format_string(label + " detected: %.2f%% average", F.col("average")),
             "Review the workload or scale up")
        for metric, limit, label in limits
    ]
    return apply_rules(metrics, rules, keys)


# Settings assessed, with their texts.
ASSESSMENTS = [
    ("Binlog_Format_Check", "binlog_format",
     [("ROW", "OPTIMAL - Using ROW format for better consistency"),
      ("MIXED", "ACCEPTABLE - Consider ROW format for better consistency")],
     "SUBOPTIMAL - Consider using ROW or MIXED format"),
    ("Sync_Binlog_Check", "sync_binlog",
     [("1", "OPTIMAL - Maximum durability enabled"),
      ("0", "RISKY - Consider setting sync_binlog=1 for durability")],
     "SUBOPTIMAL - Consider sync_binlog=1 for maximum durability"),
    ("GTID_Mode_Check", "gtid_mode",
     [("ON", "EXCELLENT - GTID enabled for easier failover management")],
     "RECOMMENDED - Consider enabling GTID mode for easier management"),
]


def config_assessment(settings: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Verdict per assessed setting; one pass over the settings instead of a lookup per rule."""
    keys = names(by)
    wide = settings.groupBy(*keys).agg(*[
        F.max(F.when(F.col("name") == setting, F.col("value"))).alias(setting) for _, setting, _, _ in ASSESSMENTS])
    rows = [
        F.struct(F.lit(check).alias("recommendation_type"),
                 bands.decode(setting, dict(labels), other).alias("assessment"),
                 F.col(setting).alias("current_value"))
        for check, setting, labels, other in ASSESSMENTS
    ]
    return wide.select(*keys, F.inline(F.array(*rows)))


# Thread states of a replica.
IO_STATES = {"Waiting for master to send event": "HEALTHY", "Connecting to master": "CONNECTING", "": "STOPPED"}
THREAD_STATES = {"Yes": "HEALTHY", "No": "CRITICAL"}


def replica_thread_status(replicas: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """State of both replication threads of the default channel, three rows per server."""
    labels = [
        ("Slave_IO_State", "slave_io_state", bands.decode("slave_io_state", IO_STATES, "CHECK_REQUIRED")),
        ("Slave_IO_Running", "slave_io_running", bands.decode("slave_io_running", THREAD_STATES, "WARNING")),
        ("Slave_SQL_Running", "slave_sql_running", bands.decode("slave_sql_running", THREAD_STATES, "WARNING")),
    ]
    rows = [F.struct(F.lit(metric).alias("metric"), status.alias("status"), F.col(col).alias("details"))
            for metric, col, status in labels]
    return replicas.filter(F.col("channel_name") == "").select(*names(by), F.inline(F.array(*rows)))


def replication_lag(replicas: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Lag band, seconds (-1 when unknown) and text of the default channel."""
    lag = F.col("seconds_behind_master")
    return replicas.filter(F.col("channel_name") == "").select(
        *names(by), F.lit("Seconds_Behind_Master").alias("metric"),
        bands.band(lag, bands.LAG_DETAIL, "CRITICAL", bands.LAG_STOPPED).alias("status"),
        F.coalesce(lag, F.lit(-1)).alias("lag_seconds"), format_duration(lag).alias("lag_formatted"))


def replication_errors(replicas: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Last receiver and applier error of the default channel."""
    def row(label: str, number: str, message: str) -> Column:
        status = F.when(F.col(number) == 0, F.lit("NO_ERROR")).otherwise(F.lit("ERROR_PRESENT"))
        return F.struct(F.lit(label).alias("error_type"), status.alias("status"),
                        F.col(number).alias("error_number"), snippet(message, 200).alias("error_message"))
    return replicas.filter(F.col("channel_name") == "").select(*names(by), F.inline(F.array(
        row("Last_IO_Error", "last_io_errno", "last_io_error"),
        row("Last_SQL_Error", "last_sql_errno", "last_sql_error"))))


def space_usage(df: DataFrame, used: str, limit: str, reclaimable: str | None = None) -> DataFrame:
    """Used, free and limit in MB, and percent of the limit."""
    out = df.withColumns({
        "used_mb": sizes.to_mb(used), "limit_mb": sizes.to_mb(limit),
        "free_mb": sizes.to_mb(F.col(limit) - F.col(used)),
        "used_percent": pct(used, limit), "free_percent": pct(F.col(limit) - F.col(used), limit),
    })
    return out if reclaimable is None else out.withColumn("reclaimable_mb", sizes.to_mb(reclaimable))


# Fixed value: fewest pages worth maintaining.
MIN_PAGES = 1000


def _maintainable(stats: DataFrame, min_pages: int) -> DataFrame:
    kept = stats.filter(F.col("page_count") >= min_pages)
    if "index_id" in stats.columns:
        kept = kept.filter(F.col("index_id") > 0)
    for flag in ("is_disabled", "is_ms_shipped"):
        if flag in stats.columns:
            kept = kept.filter(~F.col(flag))
    return kept


def fragmentation_triage(stats: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Operation and priority by fragmentation, for indexes large enough to matter.

    Where the resolved catalog columns are present, heaps, disabled indexes
    and system tables are left out.
    """
    renamed = _maintainable(stats, min_pages).withColumnRenamed("avg_fragmentation_in_percent", "fragmentation_percent")
    return renamed.withColumns({
        "operation": bands.band("fragmentation_percent", bands.FRAGMENTATION_ACTION, "NONE"),
        "priority": bands.band("fragmentation_percent", bands.FRAGMENTATION_PRIORITY, 3),
    })


def fragmentation_level(stats: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Fragmentation level after maintenance."""
    return _maintainable(stats, min_pages).withColumn(
        "fragmentation_level", bands.band("avg_fragmentation_in_percent", bands.FRAGMENTATION_LEVEL, "High"))


def triage_catalog(stats: DataFrame, indexes: DataFrame, tables: DataFrame, schemas: DataFrame,
                   min_pages: int = MIN_PAGES, by: Iterable[str] | None = None) -> DataFrame:
    """Triage with object names; small indexes are dropped before the joins."""
    large = stats.filter(F.col("page_count") >= min_pages)
    return fragmentation_triage(resolve_objects(large, indexes, tables, schemas, by), min_pages)
