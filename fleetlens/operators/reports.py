"""Named database reports."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import names
from ..functions.numbers import pct, ratio, share_of
from ..functions.sizes import format_bytes, to_mb
from ..functions.text import joined_args, packed_numbers, snippet
from ..functions.times import parse_when
from .aggregates import count_by
from .filters import exclude_system, index_bytes, write_volume
from .ordering import latest_n, top_n

# Schemas and databases that belong to the system.
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog"]
SYSTEM_STORES = ["local", "admin", "config"]


def _sorted(df: DataFrame, order: Sequence[Column], ordered: bool) -> DataFrame:
    return df.orderBy(*order) if ordered else df


def table_sizes(tables: DataFrame, n: int = 20, by: Iterable[str] | None = None) -> DataFrame:
    """Largest user tables with total, table and index size, ``n`` per server where ``by`` names its keys."""
    user = exclude_system(tables, "schemaname", exact=SYSTEM_SCHEMAS)
    largest = top_n(user, [F.desc_nulls_last("total_bytes"), F.asc("schemaname"), F.asc("tablename")], n, by)
    return index_bytes(largest).select(
        *names(by), "schemaname", "tablename", format_bytes("total_bytes").alias("total_size"),
        format_bytes("table_bytes").alias("table_size"), format_bytes("index_bytes").alias("index_size"),
        F.col("total_bytes").alias("size_bytes"))


def database_sizes(databases: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Size of each database that is not a template, largest first."""
    return databases.filter(~F.col("datistemplate")).select(
        *names(by), F.col("datname").alias("database_name"), format_bytes("size_bytes").alias("size"), "size_bytes",
    ).orderBy(F.desc_nulls_last("size_bytes"), "database_name")


def index_usage(indexes: DataFrame, by: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
    """Entries read and rows fetched per index; the ratio is 0 where nothing was read."""
    out = indexes.select(*names(by), "schemaname", "tablename", "indexname", "idx_tup_read", "idx_tup_fetch",
                         pct("idx_tup_fetch", "idx_tup_read", on_zero="zero").alias("fetch_ratio_percent"))
    return _sorted(out, [F.desc_nulls_last("idx_tup_read")], ordered)


def unused_indexes(indexes: DataFrame, larger_than: int = 1024 * 1024, by: Iterable[str] | None = None,
                   ordered: bool = True) -> DataFrame:
    """Indexes never scanned and larger than the limit, largest first."""
    kept = indexes.filter((F.col("idx_scan") == 0) & (F.col("index_bytes") > larger_than))
    out = kept.select(*names(by), "schemaname", "tablename", "indexname", format_bytes("index_bytes").alias("index_size"),
                      "index_bytes", "idx_scan", "idx_tup_read", "idx_tup_fetch")
    return _sorted(out, [F.desc_nulls_last("index_bytes")], ordered)


def missing_index_candidates(tables: DataFrame, scans: int = 100, rows: int = 1000,
                             by: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
    """Tables read sequentially often and in bulk."""
    kept = write_volume(tables.filter((F.col("seq_scan") > scans) & (F.col("seq_tup_read") > rows)))
    out = kept.select(*names(by), "schemaname", "tablename", "seq_scan", "seq_tup_read", "total_writes",
                      ratio("seq_tup_read", "seq_scan").alias("avg_seq_read_per_scan"))
    return _sorted(out, [F.desc_nulls_last("seq_tup_read")], ordered)


def top_queries(statements: DataFrame, by: str = "total_time", n: int = 10, tie: Sequence[str] = (),
                per: Iterable[str] | None = None) -> DataFrame:
    """Statements that took most time, or ran most often; ``n`` per server where ``per`` names its keys."""
    best = top_n(statements, [F.desc_nulls_last(by), *[F.asc(c) for c in tie]], n, per)
    return best.select(
        *names(per), *tie, snippet("query", 100).alias("query_snippet"), "calls", "total_time", "mean_time", "rows",
        share_of("shared_blks_hit", "shared_blks_read").alias("hit_percent"))


def vacuum_candidates(tables: DataFrame, dead: int = 1000, by: Iterable[str] | None = None,
                      ordered: bool = True) -> DataFrame:
    """Tables with many dead rows."""
    out = tables.filter(F.col("n_dead_tup") > dead).select(
        *names(by), "schemaname", "tablename", "n_dead_tup", "n_live_tup",
        pct("n_dead_tup", "n_live_tup").alias("dead_tuple_percent"), "last_vacuum", "last_autovacuum")
    return _sorted(out, [F.desc_nulls_last("dead_tuple_percent")], ordered)


def analyze_candidates(tables: DataFrame, modified: int = 1000, by: Iterable[str] | None = None,
                       ordered: bool = True) -> DataFrame:
    """Tables with many changes since their statistics were taken."""
    out = tables.filter(F.col("n_mod_since_analyze") > modified).select(
        *names(by), "schemaname", "tablename", "n_mod_since_analyze", "last_analyze", "last_autoanalyze")
    return _sorted(out, [F.desc_nulls_last("n_mod_since_analyze")], ordered)


def slow_ops(profile: DataFrame, order_by: str = "recent", n: int = 10, tie: Sequence[str] = (),
             by: Iterable[str] | None = None) -> DataFrame:
    """Profiled operations, the latest or the slowest, with examined and returned counts; ``n`` per key of ``by``."""
    column = {"recent": "ts", "slowest": "millis"}[order_by]
    best = top_n(profile, [F.desc_nulls_last(column), *[F.desc(c) for c in tie]], n, by)
    return best.select(
        *names(by), *tie, "ts", "millis", "op", "ns", snippet("command", 100, ellipsis=True).alias("command"),
        F.coalesce("docsExamined", F.lit(0)).alias("docs_examined"),
        F.coalesce("nreturned", F.lit(0)).alias("docs_returned"))


def slow_log(entries: DataFrame, n: int = 10, by: Iterable[str] | None = None) -> DataFrame:
    """Latest entries of a cache server's slow log, ``n`` per server where ``by`` names its keys."""
    return top_n(entries, [F.desc("id")], n, by).select(
        *names(by), "id", parse_when("start_time", "epoch").alias("timestamp"),
        F.col("duration").alias("duration_microseconds"),
        (F.col("duration") / F.lit(1000.0)).alias("duration_milliseconds"),
        joined_args("command").alias("command"),
        F.coalesce("client_address", F.lit("Unknown")).alias("client_address"),
        F.coalesce("client_name", F.lit("Unknown")).alias("client_name"))


def collection_stats(collections: DataFrame, n: int = 10, by: Iterable[str] | None = None) -> DataFrame:
    """Largest collections with document counts and sizes, ``n`` per server where ``by`` names its keys."""
    numbers = ["count", "size", "storageSize", "totalIndexSize"]
    filled = collections.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in numbers})
    return top_n(filled, [F.desc("size"), F.asc("name")], n, by).select(
        *names(by), "name", "count", to_mb("size").alias("size_mb"), to_mb("storageSize").alias("storage_mb"),
        ratio("size", "count").alias("avg_doc_size"), to_mb("totalIndexSize").alias("index_mb"))


def store_statistics(databases: DataFrame) -> DataFrame:
    """Sizes and object counts of document databases, system ones left out."""
    return exclude_system(databases, "name", exact=SYSTEM_STORES).select(
        "name", to_mb("dataSize").alias("size_mb"), to_mb("storageSize").alias("storage_mb"),
        "collections", "indexes", "objects")


def counters_long(df: DataFrame, counters: str, keys: Iterable[str]) -> DataFrame:
    """Map of counters as one row per counter."""
    return df.select(*names(keys), F.explode(counters).alias("counter", "value"))


def lock_counters_long(df: DataFrame, locks: str, keys: Iterable[str]) -> DataFrame:
    """Map of lock type to mode counts as one row per type and mode."""
    types = df.select(*names(keys), F.explode(locks).alias("lock_type", "modes"))
    return types.select(*names(keys), "lock_type", F.explode("modes").alias("mode", "acquired"))


def store_cache_ratios(df: DataFrame) -> DataFrame:
    """Hit ratio of the storage cache; ``ref_ratio`` is the share of pages read in."""
    return df.withColumns({
        "hit_ratio": pct(F.col("pages_requested") - F.col("pages_read_in"), "pages_requested"),
        "ref_ratio": share_of("pages_read_in", "pages_requested"),
    })


def topology_hosts(peers: DataFrame, local: DataFrame) -> DataFrame:
    """Hosts of a cluster with their number of tokens; the local host is listed as such."""
    def host(df: DataFrame, peer: Column) -> DataFrame:
        return df.select(peer.alias("peer"), "data_center", "rack", "version",
                         F.coalesce(F.size("tokens"), F.lit(0)).alias("tokens"))
    known = F.coalesce(F.col("peer").cast("string"), F.lit("Unknown"))
    return host(peers, known).unionByName(host(local, F.lit("local")))


def hosts_per_data_center(hosts: DataFrame) -> DataFrame:
    return count_by(hosts, "data_center", out="hosts")


def user_keyspaces(keyspaces: DataFrame, include_system: bool = False) -> DataFrame:
    """Keyspaces whose name does not start with ``system``."""
    return exclude_system(keyspaces, "name", prefixes=["system"], include_system=include_system)


# Defaults of missing node fields.
NODE_DEFAULTS = {"id": "Unknown", "host": "Unknown", "port": 0, "master": "Unknown"}


def cluster_nodes(df: DataFrame, keys: Iterable[str], nodes: str = "nodes") -> DataFrame:
    """Nested node lists as one row per node, with role and number of slot ranges."""
    rows = df.select(*names(keys), F.explode(nodes).alias("n"))
    fields = [F.coalesce(F.col(f"n.{name}"), F.lit(value)).alias(name) for name, value in NODE_DEFAULTS.items()]
    return rows.select(
        *names(keys), *fields,
        F.coalesce(F.array_contains("n.flags", "master"), F.lit(False)).alias("is_master"),
        F.coalesce(F.size("n.slots"), F.lit(0)).alias("slot_ranges"))


def keyspace_info(df: DataFrame, keys: Iterable[str], info: str = "keyspace") -> DataFrame:
    """Counts per logical database from packed strings such as ``keys=1,expires=0,avg_ttl=0``."""
    rows = df.select(*names(keys), F.explode(info).alias("database", "packed"))
    parsed = rows.filter(F.col("database").startswith("db")).withColumn("m", packed_numbers("packed"))
    return parsed.select(*names(keys), "database", *[
        F.try_element_at("m", F.lit(name)).alias(name) for name in ("keys", "expires", "avg_ttl")])




def server_report(sections: Mapping[str, DataFrame], by: Sequence[str],
                  lists: Mapping[str, tuple[DataFrame, Sequence[Column], int]] | None = None) -> DataFrame:
    """One nested row per server: a struct per section, and short lists such as the latest backups.

    Sections hold one row per server.  Lists are cut to their first ``n`` rows
    per server before they are gathered, so no group grows with the data.
    """
    packed = []
    for name, df in sections.items():
        rest = [c for c in df.columns if c not in by]
        packed.append(df.select(*by, F.struct(*rest).alias(name)))
    for name, (df, order, n) in (lists or {}).items():
        rest = [c for c in df.columns if c not in by]
        first = latest_n(df, by, order, n, rank="_rank")
        packed.append(first.groupBy(*by).agg(
            F.sort_array(F.collect_list(F.struct("_rank", *rest))).alias(name)))
    report = packed[0]
    for part in packed[1:]:
        report = report.join(part, list(by), "full")
    return report
