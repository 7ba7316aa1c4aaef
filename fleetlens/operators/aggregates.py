"""Aggregations. Each is one map-side combined pass unless it says otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bands
from ..functions.columns import names
from ..functions.numbers import pct, ratio, share_of
from ..functions.sizes import format_bytes
from ..functions.text import key_prefix
from ..functions.times import Instant, instant_like, span
from .movement import row_hash
from .ordering import latest_n, top_n


def count_by(df: DataFrame, keys: str | Iterable[str], out: str = "count") -> DataFrame:
    """Rows per key, largest first."""
    return df.groupBy(*names(keys)).agg(F.count("*").alias(out)).orderBy(F.desc(out), *names(keys))


# Order of the operations in the summary.
OPERATION_ORDER = ["REBUILD", "REORGANIZE"]


def operation_summary(triage: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Count, pages and fragmentation range per operation that needs work."""
    keys = names(by)
    return (
        triage.filter(F.col("operation") != "NONE")
        .groupBy(*keys, "operation")
        .agg(F.count("*").alias("index_count"), F.sum("page_count").alias("total_pages"),
             _mean("fragmentation_percent").alias("avg_fragmentation"),
             F.min("fragmentation_percent").alias("min_fragmentation"),
             F.max("fragmentation_percent").alias("max_fragmentation"))
        .orderBy(*keys, bands.rank_in("operation", OPERATION_ORDER))
    )


def cache_hit_ratio(stats: DataFrame, by: Iterable[str] | None = None, only_with_reads: bool = False) -> DataFrame:
    """Percent of block requests served from the cache, over the fleet or per key."""
    out = stats.groupBy(*names(by)).agg(F.sum("blks_hit").alias("blks_hit"), F.sum("blks_read").alias("blks_read"))
    out = out.withColumn("cache_hit_ratio", share_of("blks_hit", "blks_read"))
    return out.filter(F.col("blks_read") > 0) if only_with_reads else out


# Check names and texts of the replication summary.
NOT_CONFIGURED = "This server is not configured as a replication slave"
SEE_METRICS = "Check individual metrics above for details"
NOT_A_REPLICA = "Not a slave server"
SEE_ERRORS = "Check error details above"


def replication_summary(replicas: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Health, lag and error verdict of the default channel, three rows per server.

    Conditions are strict about NULL: a thread in an unknown state counts
    neither as running nor as stopped.
    """
    keys = names(by)
    mine = F.col("channel_name") == ""
    io, sql = F.col("slave_io_running"), F.col("slave_sql_running")
    counts = replicas.groupBy(*keys).agg(
        F.count_if(mine).alias("n"),
        F.count_if(mine & (io == "Yes") & (sql == "Yes")).alias("running"),
        F.count_if(mine & ((io != "Yes") | (sql != "Yes"))).alias("stopped"),
        F.max(F.when(mine, F.col("seconds_behind_master"))).alias("lag"),
        F.count_if(mine & ((F.col("last_io_errno") != 0) | (F.col("last_sql_errno") != 0))).alias("errors"),
    )
    none = F.col("n") == 0
    health = F.when(F.col("running") > 0, "HEALTHY").when(F.col("stopped") > 0, "UNHEALTHY").otherwise("NOT_A_SLAVE")
    errors = F.when(F.col("errors") > 0, "ERRORS_PRESENT").when(none, "NOT_APPLICABLE").otherwise("NO_ERRORS")
    lag_text = F.concat(F.coalesce("lag", F.lit(-1)).cast("string"), F.lit(" seconds behind master"))

    def check(name: str, status: Column, details: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), status.alias("status"), details.alias("details"))

    return counts.select(*keys, F.inline(F.array(
        check("Overall_Replication_Health", health, F.when(none, NOT_CONFIGURED).otherwise(SEE_METRICS)),
        check("Replication_Lag_Status", bands.band("lag", bands.LAG_SUMMARY, "HIGH_LAG", bands.LAG_STOPPED), lag_text),
        check("Replication_Errors", errors, F.when(none, NOT_A_REPLICA).otherwise(SEE_ERRORS)),
    )))


def backup_success_rate(reports: DataFrame, by: Iterable[str] | None = None, int_pct: bool = False) -> DataFrame:
    """Runs, successes, failures and success percent per key."""
    counts = reports.groupBy(*names(by)).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "Success").alias("successful"))
    rate = pct("successful", "total")
    rate = F.floor(rate).cast("long") if int_pct else rate
    return counts.withColumn("failed", F.col("total") - F.col("successful")).withColumn("success_rate", rate)


def size_rollup(df: DataFrame, keys: Sequence[str], size: str = "bytes", out: str = "total_bytes") -> DataFrame:
    """Summed size per key prefix and in total; ``level`` has a bit set for every key left out.

    The rollup multiplies rows, so it runs on sums per full key.
    """
    finest = df.groupBy(*keys).agg(F.sum(size).alias("_size"), F.count("*").alias("_objects"))
    return finest.rollup(*keys).agg(
        F.sum("_size").alias(out), F.sum("_objects").alias("objects"), F.grouping_id().alias("level"))


def database_inventory(tables: DataFrame, by: Iterable[str] = ("database",), top: int | None = None,
                       per: Iterable[str] | None = None) -> DataFrame:
    """Tables, rows and bytes per database, largest first; ``top`` of them, of each server where ``per`` names its keys."""
    keys = names(by)
    out = tables.groupBy(*keys).agg(
        F.count("*").alias("tables"), F.sum(F.coalesce("total_rows", F.lit(0))).alias("rows"),
        F.sum(F.coalesce("total_bytes", F.lit(0))).alias("bytes"),
    )
    order = [F.desc("bytes"), *[F.asc(key) for key in keys]]
    return out.orderBy(*order) if top is None else top_n(out, order, top, per)


def ranked_tables(tables: DataFrame, top: int = 20, by: Iterable[str] = ("database",),
                  per: Iterable[str] | None = None) -> DataFrame:
    """Largest tables with rows, bytes and size as text, ``top`` per server where ``per`` names its keys."""
    keys = names(by)
    best = top_n(tables, [F.desc_nulls_last("total_bytes"), *[F.asc(key) for key in keys], F.asc("name")], top, per)
    return best.select(*keys, "name", "total_rows", "total_bytes", format_bytes("total_bytes").alias("size_human"))


def _keyed(df: DataFrame, key: str, kind: str, size: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(kind).alias("type"),
                     F.coalesce(F.col(size), F.lit(0)).alias("bytes"), key_prefix(key).alias("pattern"))


def key_pattern_types(df: DataFrame, key: str = "key", kind: str = "type", size: str = "bytes") -> DataFrame:
    """Keys and bytes per prefix and type, one row each."""
    return _keyed(df, key, kind, size).groupBy("pattern", "type").agg(
        F.count("*").alias("n"), F.sum("bytes").alias("total"), F.max("bytes").alias("largest"))


def _per_pattern(per_type: DataFrame) -> DataFrame:
    return per_type.groupBy("pattern").agg(
        F.sum("n").alias("count"), F.sum("total").alias("total_size"), F.max("largest").alias("max_size"),
    ).withColumn("avg_size", ratio("total_size", "count"))


def key_patterns(df: DataFrame, key: str = "key", kind: str = "type", size: str = "bytes") -> DataFrame:
    """Key-space profile: number and sizes of the keys of every prefix; their types are in :func:`key_pattern_types`."""
    return _per_pattern(key_pattern_types(df, key, kind, size))


def top_patterns(df: DataFrame, key: str = "key", kind: str = "type", size: str = "bytes", samples: int = 5,
                 top: int = 10) -> DataFrame:
    """The ``top`` most frequent key prefixes with sizes, types and their first keys in order.

    Types and keys are gathered for the listed prefixes only.
    """
    per_type = key_pattern_types(df, key, kind, size)
    best = _per_pattern(per_type).orderBy(F.desc("count"), "pattern").limit(top)
    listed = best.select("pattern")
    types = per_type.join(listed, "pattern", "left_semi").groupBy("pattern").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"))
    keys = _keyed(df, key, kind, size).select("pattern", "key").join(listed, "pattern", "left_semi")
    firsts = latest_n(keys, ["pattern"], [F.asc("key")], samples)
    lists = firsts.groupBy("pattern").agg(F.sort_array(F.collect_list("key")).alias("sample_keys"))
    return best.join(types, "pattern", "left").join(lists, "pattern", "left")


def frequent_patterns(df: DataFrame, key: str = "key", size: str = "bytes", top: int = 10, tracked: int = 10_000) -> DataFrame:
    """The ``top`` most frequent key prefixes as in :func:`key_patterns`, with memory and shuffle bounded by ``tracked``.

    A first pass keeps a mergeable summary of ``tracked`` prefixes per task and
    merges them. It holds every prefix with more than ``error_bound`` keys, so
    a second pass counts those alone, exactly; at most ``tracked`` of them are
    broadcast. ``certain``: the list is full and its last prefix has more keys
    than that, or nothing can be missing, so none outside the summary belongs in
    the list. Prefixes of equal count
    come by name; NULL is a prefix.
    """
    keyed = df.select(key_prefix(key).alias("pattern"), F.coalesce(F.col(size), F.lit(0)).alias("bytes"))
    summary = keyed.agg(F.expr(f"approx_top_k_accumulate(pattern, {tracked})").alias("state"), F.count("*").alias("keys"))
    # The summary's map has a power of two of slots, three quarters of them in use.
    slots = 1 << (-(-tracked * 4 // 3) - 1).bit_length()
    bound = summary.select((F.col("keys") * F.lit(3.5 / slots)).alias("error_bound"))
    found = summary.select(F.explode(F.expr(f"approx_top_k_estimate(state, {tracked})")).alias("one")).select(F.col("one.item").alias("_pattern"))
    listed = F.broadcast(found.unionByName(df.sparkSession.range(1).select(F.lit(None).cast("string").alias("_pattern"))).distinct())
    exact = keyed.join(listed, F.col("pattern").eqNullSafe(F.col("_pattern")), "left_semi").groupBy("pattern").agg(
        F.count("*").alias("count"), F.sum("bytes").alias("total_size"), F.max("bytes").alias("max_size"))
    best = exact.orderBy(F.desc("count"), "pattern").limit(top)
    listed_ones = Window.partitionBy(F.lit(0))
    full = (F.count("*").over(listed_ones) == top) & (F.min("count").over(listed_ones) > F.col("error_bound"))
    return best.withColumns({"avg_size": ratio("total_size", "count"), "error_bound": bound.scalar()}).withColumn(
        "certain", full | (F.col("error_bound") < 1))


def key_totals(df: DataFrame, size: str = "bytes") -> DataFrame:
    """Keys and memory analysed."""
    return df.agg(F.count("*").alias("total_keys_analyzed"),
                  F.sum(F.coalesce(F.col(size), F.lit(0))).alias("total_memory_analyzed"))


def key_sample(df: DataFrame, key: str, one_in: int) -> DataFrame:
    """Repeatable sample by hash: about one key in ``one_in``."""
    drawn = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("long")
    return df.filter(drawn % one_in == 0)


def shard_distribution(chunks: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Chunks per shard of every object that spans several shards, with its skew."""
    keys = [*names(by), "ns"]
    per_shard = chunks.groupBy(*keys, "shard").agg(F.count("*").alias("chunks"))
    spread = per_shard.groupBy(*keys).agg(
        F.count("*").alias("shards"), F.max("chunks").alias("_most"), F.min("chunks").alias("_least"),
    ).filter(F.col("shards") > 1).select(*keys, "shards", ratio("_most", "_least").alias("skew"))
    return per_shard.join(spread, keys)


def series_cardinality(df: DataFrame, tags: Sequence[str], by: Iterable[str] | None = None,
                       approx: bool = False) -> DataFrame:
    """Number of distinct tag combinations, exact or approximate."""
    keys = names(by)
    if approx:
        return df.groupBy(*keys).agg(F.approx_count_distinct(F.struct(*tags)).alias("series"))
    return df.select(*keys, *tags).distinct().groupBy(*keys).agg(F.count("*").alias("series"))


def cardinality_states(df: DataFrame, tags: Sequence[str], by: Iterable[str] | None = None, ts: str = "ts",
                       unit: str = "hour", lg_k: int = 12) -> DataFrame:
    """Rows (by, span, state): a mergeable sketch of the distinct tag combinations of every hour (or ``unit``).

    A state has at most 2^lg_k registers whatever it has seen. Stored, the
    states answer for any span of hours without the rows they were made from;
    rows that come late are one more state of their hour.
    """
    span = F.date_trunc(unit, F.col(ts).cast("timestamp")).cast(df.schema[ts].dataType)
    return df.groupBy(*names(by), span.alias("span")).agg(F.hll_sketch_agg(row_hash(df, tags), F.lit(lg_k)).alias("state"))


def cardinality_rollup(states: DataFrame, by: Iterable[str] | None = None, unit: str | None = None) -> DataFrame:
    """Distinct tag combinations per ``unit`` (or over all states), from states alone; the standard error is 1.04 / sqrt(2^lg_k)."""
    keys = names(by)
    spans = [] if unit is None else [F.date_trunc(unit, F.col("span").cast("timestamp")).cast(states.schema["span"].dataType).alias("span")]
    return states.groupBy(*keys, *spans).agg(F.hll_sketch_estimate(F.hll_union_agg("state")).alias("series"))


def measurements(df: DataFrame, col: str = "measurement") -> DataFrame:
    """Names of the measurements present."""
    return df.select(col).distinct()


def _mean(col: str) -> Column:
    """Sum by count: exact for whole numbers and decimals, whatever the partitioning."""
    return ratio(F.sum(col), F.count(col))


def hourly_points(df: DataFrame, keys: Iterable[str], ts: str = "ts", value: str = "value", width: str = "1 hour",
                  slide: str | None = None) -> DataFrame:
    """Average per key and time window."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.groupBy(*names(keys), window.alias("w")).agg(_mean(value).alias("average")).select(
        *names(keys), F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "average")


def hourly_metrics(df: DataFrame, as_of: Instant, hours: int = 24, keys: Iterable[str] = ("metric",), ts: str = "ts",
                   value: str = "value", digits: int | None = 2) -> DataFrame:
    """Average and maximum of the hourly averages of the last hours; rounds half to even."""
    end = instant_like(df, ts, as_of)
    recent = df.filter((F.col(ts) >= end - span(hours * 3600)) & (F.col(ts) < end))
    out = hourly_points(recent, keys, ts, value).groupBy(*names(keys)).agg(
        _mean("average").alias("average"), F.max("average").alias("maximum"))
    if digits is None:
        return out
    return out.withColumns({c: F.bround(c, digits) for c in ("average", "maximum")})


def snapshot_contents(df: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Tables of each snapshot with their sizes, one row per table."""
    return df.groupBy(*names(by), "snapshot", "keyspace", "table").agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum("true_size_bytes").alias("true_size_bytes"))


def snapshot_totals(df: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Number of tables and summed sizes per snapshot."""
    return snapshot_contents(df, by).groupBy(*names(by), "snapshot").agg(
        F.count("*").alias("tables"), F.sum("size_bytes").alias("total_size"),
        F.sum("true_size_bytes").alias("total_true_size"))


def latest_metric(df: DataFrame, keys: Iterable[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Latest datapoint per object and metric; equal instants go to the larger value."""
    newest = F.max(F.struct(F.col(ts), F.col(value))).alias("_newest")
    return df.groupBy(*names(keys)).agg(newest).select(
        *names(keys), F.col(f"_newest.{ts}").alias(ts), F.col(f"_newest.{value}").alias(value))


def backup_config_issues(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    """Objects whose automated backups are off, as issue lines."""
    def lines(df: DataFrame, kind: str) -> DataFrame:
        return df.filter(F.col("backup_retention_period") == 0).select(
            F.lit(kind).alias("kind"), "identifier",
            F.concat(F.lit(f"{kind} "), "identifier", F.lit(" has automated backups disabled")).alias("issue"))
    return lines(instances, "Instance").unionByName(lines(clusters, "Cluster"))


def backup_config_counts(instances: DataFrame, clusters: DataFrame) -> DataFrame:
    """Objects and objects without automated backups, per kind."""
    both = instances.select(F.lit("Instance").alias("kind"), "backup_retention_period").unionByName(
        clusters.select(F.lit("Cluster").alias("kind"), "backup_retention_period"))
    return both.groupBy("kind").agg(F.count("*").alias("total"),
                                    F.count_if(F.col("backup_retention_period") == 0).alias("issues"))


# Severities from mild to grave.
SEVERITIES = ["INFO", "WARNING", "CRITICAL", "ERROR"]


def rollup_status(findings: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Findings per category and severity, and whether anything beyond INFO was found."""
    counts = [F.count_if(F.col("severity") == name).alias(name.lower()) for name in SEVERITIES]
    grave = F.max(bands.rank_in("severity", SEVERITIES))
    return findings.groupBy(*names(by)).agg(
        F.count("*").alias("findings"), *counts,
        F.when(grave > 0, F.lit("ISSUES_FOUND")).otherwise(F.lit("HEALTHY")).alias("status"))


# What the summaries look for in backup logs.
PIECE_MARK = "piece handle="
INPUT_SIZE = r"input datafile size=([0-9.]*[A-Z])"
OUTPUT_SIZE = r"output size=([0-9.]*[A-Z])"
ERROR_CODE = r"RMAN-[0-9]+:|ORA-[0-9]+:"
FAILED_VALIDATION = r"validation failed|found corruption|FAILED"


def backup_log_summary(lines: DataFrame, by: Iterable[str] = ("path",)) -> DataFrame:
    """Pieces, last sizes, error lines and validation verdict per log."""
    text, no = F.col("value"), F.col("line_no")

    def last(pattern: str) -> Column:
        found = F.regexp_extract("value", pattern, 1)
        return F.max_by(F.when(found != "", found), F.when(found != "", no))

    return lines.groupBy(*names(by)).agg(
        F.count("*").alias("lines"),
        F.count_if(text.contains(PIECE_MARK)).alias("pieces"),
        F.coalesce(last(INPUT_SIZE), F.lit("Unknown")).alias("input_size"),
        F.coalesce(last(OUTPUT_SIZE), F.lit("Unknown")).alias("output_size"),
        F.count_if(text.rlike(ERROR_CODE)).alias("error_lines"),
        F.when(F.count_if(text.rlike(FAILED_VALIDATION)) > 0, F.lit("ISSUES_FOUND"))
        .otherwise(F.lit("VALID")).alias("validation"),
    )


def backup_log_errors(lines: DataFrame) -> DataFrame:
    """Every line with an error code, and its codes."""
    codes = F.regexp_extract_all("value", F.lit(r"(RMAN-[0-9]+|ORA-[0-9]+):"), 1)
    return lines.filter(F.col("value").rlike(ERROR_CODE)).withColumn("codes", codes)


def log_tail(lines: DataFrame, n: int = 10, by: Iterable[str] = ("path",)) -> DataFrame:
    """Last lines of each log."""
    return latest_n(lines, names(by), [F.desc("line_no")], n)



def metric_rows(df: DataFrame, specs: Mapping[str, Column], keys: Iterable[str] | None = None,
                name: str = "metric", value: str = "value") -> DataFrame:
    """A wide row as labelled metric rows, from one scan."""
    rows = [F.struct(F.lit(label).alias(name), col.alias(value)) for label, col in specs.items()]
    return df.select(*names(keys), F.inline(F.array(*rows)))
