"""Joins of telemetry with its catalogs.

Join sides are filtered and pre-aggregated before they meet.  No broadcast is
forced: Spark broadcasts a side only after checking its size against
``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, with
hot keys split at run time.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import bands, sizes, times
from ..functions.columns import names

# The columns that name a lock, compared null-safe.
LOCK_KEY = [
    "locktype", "database", "relation", "page", "tuple", "virtualxid", "transactionid",
    "classid", "objid", "objsubid",
]


def lock_contention(locks: DataFrame, sessions: DataFrame, by: Iterable[str] | None = None,
                    lock_key: Sequence[str] = LOCK_KEY) -> DataFrame:
    """Who waits and who stands in the way, per lock, in linear space.

    The blocking pairs of a lock are every waiting request with every request
    of another session on the same lock: as many as the product of both. This
    result holds the same facts in one row per lock, session and role:
    ``blocked`` (with the number of requests not granted) or ``blocking``
    (with the number of all its requests), and how many requests it meets on
    the other side. A pair is a blocked and a blocking row of one lock with
    different pids, see :func:`blocking_pairs`.
    """
    keys = [*names(by), *lock_key]
    # Two structs are equal where their fields are, NULL included: one hashable join key.
    packed = locks.filter(F.col("locktype").isNotNull()).select(
        *names(by), F.struct(*keys).alias("lock"), "pid", (~F.col("granted")).cast("long").alias("waits"))
    per_pid = packed.groupBy(*names(by), "lock", "pid").agg(F.count("*").alias("own"), F.sum("waits").alias("own_waits"))
    known = per_pid.join(sessions.select(*names(by), "pid", "usename", F.col("query").alias("statement")),
                         [*names(by), "pid"])
    per_lock = (
        known.groupBy("lock").agg(F.sum("own").alias("all_own"), F.sum("own_waits").alias("all_waits"))
        .filter((F.col("all_waits") > 0) & (F.col("all_own") > 1))
    )
    blockers, waiters = F.col("all_own") - F.col("own"), F.col("all_waits") - F.col("own_waits")
    sides = F.filter(F.array(
        F.when((F.col("own_waits") > 0) & (blockers > 0), F.struct(
            F.lit("blocked").alias("role"), F.col("own_waits").alias("requests"), blockers.alias("partners"))),
        F.when(waiters > 0, F.struct(
            F.lit("blocking").alias("role"), F.col("own").alias("requests"), waiters.alias("partners"))),
    ), lambda side: side.isNotNull())
    return known.join(per_lock, "lock").select("lock.*", "pid", "usename", "statement", F.inline(sides))


def blocking_pairs(contention: DataFrame, blocked: Sequence[int] | Column, by: Iterable[str] | None = None,
                   lock_key: Sequence[str] = LOCK_KEY) -> DataFrame:
    """Blocked session with each session that blocks it, for the waiters named or marked by a condition on ``contention``.

    There are as many pairs as the waiters have ``partners``.
    """
    lock = F.struct(*names(by), *lock_key).alias("lock")
    wanted = blocked if isinstance(blocked, Column) else F.col("pid").isin(*blocked)
    waits = contention.filter((F.col("role") == "blocked") & wanted).select(
        lock, F.col("pid").alias("blocked_pid"), F.col("usename").alias("blocked_user"),
        F.col("statement").alias("blocked_statement"), F.col("requests").alias("waiting"))
    holds = contention.filter(F.col("role") == "blocking").select(
        lock, F.col("pid").alias("blocking_pid"), F.col("usename").alias("blocking_user"),
        F.col("statement").alias("blocking_statement"), F.col("requests").alias("holding"))
    return (
        waits.join(holds, "lock").filter(F.col("blocked_pid") != F.col("blocking_pid"))
        .select(*[F.col(f"lock.{key}") for key in names(by)], "blocked_pid", "blocked_user", "blocking_pid",
                "blocking_user", "blocked_statement", "blocking_statement",
                (F.col("waiting") * F.col("holding")).alias("pairs"))
    )


def lock_waiters(tables: DataFrame, locks: DataFrame, sessions: DataFrame, as_of: times.Instant,
                 by: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
    """Lock requests not granted, with table, owner and age of the statement."""
    keys = names(by)
    waits = locks.filter(~F.col("granted")).select(
        *keys, F.col("relation").alias("relid"), "pid", "locktype", "mode", "granted")
    out = (
        waits.join(tables.select(*keys, "relid", "schemaname", "tablename"), [*keys, "relid"])
        .join(sessions.select(*keys, "pid", "usename", "query", "query_start"), [*keys, "pid"])
        .select(*keys, "schemaname", "tablename", "locktype", "mode", "granted", "usename", "query",
                "query_start", times.seconds_since("query_start", as_of).alias("age_seconds"))
    )
    return out.orderBy(F.asc_nulls_last("query_start")) if ordered else out


def resolve_objects(stats: DataFrame, indexes: DataFrame, tables: DataFrame, schemas: DataFrame,
                    by: Iterable[str] | None = None) -> DataFrame:
    """Index statistics with schema, table and index name."""
    keys = names(by)
    index_names = indexes.select(*keys, "object_id", "index_id", F.col("name").alias("index_name"), "is_disabled")
    table_names = tables.select(*keys, "object_id", F.col("name").alias("table_name"), "schema_id", "is_ms_shipped")
    schema_names = schemas.select(*keys, "schema_id", F.col("name").alias("schema_name"))
    return (
        stats.join(index_names, [*keys, "object_id", "index_id"])
        .join(table_names, [*keys, "object_id"])
        .join(schema_names, [*keys, "schema_id"])
    )


def backup_history(sets: DataFrame, media: DataFrame, database: str | None = None, n: int = 10) -> DataFrame:
    """Latest backups with kind, duration, sizes and device."""
    wanted = sets if database is None else sets.filter(F.col("database_name") == database)
    return (
        wanted.join(media.select("media_set_id", "physical_device_name"), "media_set_id")
        .orderBy(F.desc_nulls_last("backup_start_date"), F.asc("media_set_id"), F.asc("backup_size"))
        .limit(n)
        .select(
            "database_name", "backup_start_date", "backup_finish_date",
            times.elapsed("backup_start_date", "backup_finish_date").alias("duration_seconds"),
            bands.decode("type", bands.BACKUP_KINDS).alias("backup_type"),
            sizes.to_mb("backup_size").alias("backup_size_mb"),
            sizes.to_mb("compressed_backup_size").alias("compressed_size_mb"),
            "physical_device_name",
        )
    )


# Fixed value: size of a data page in KB.
PAGE_KB = 8.0


def database_size(databases: DataFrame, files: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Databases with the summed size of their files in MB."""
    keys = [*names(by), "database_id"]
    pages = files.groupBy(*keys).agg(F.sum("size").alias("pages"))
    return databases.join(pages, keys).withColumn(
        "size_mb", F.col("pages").cast("double") * PAGE_KB / 1024.0).drop("pages")


# Column type ids that rule out an online rebuild (image, text, ntext, xml).
LOB_TYPES = [34, 35, 99, 241]


def can_rebuild_online(indexes: DataFrame, index_columns: DataFrame, columns: DataFrame,
                       by: Iterable[str] | None = None) -> DataFrame:
    """Indexes with a flag: no large-object column among their columns."""
    keys = names(by)
    lobs = columns.filter(F.col("system_type_id").isin(*LOB_TYPES)).select(*keys, "object_id", "column_id")
    offending = (
        index_columns.join(lobs, [*keys, "object_id", "column_id"], "left_semi")
        .select(*keys, "object_id", "index_id").distinct().withColumn("_lob", F.lit(True))
    )
    return (
        indexes.join(offending, [*keys, "object_id", "index_id"], "left")
        .withColumn("can_rebuild_online", F.col("_lob").isNull()).drop("_lob")
    )


def replica_lag(members: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Seconds each secondary is behind the primary of its set; no optime, no row."""
    keys = [*names(by), "set"]
    timed = members.filter(F.col("optimeDate").isNotNull())
    primary = timed.filter(F.col("stateStr") == "PRIMARY").groupBy(*keys).agg(
        F.max("optimeDate").alias("primary_optime"))
    return (
        timed.filter(F.col("stateStr") == "SECONDARY").join(primary, keys)
        .select(*keys, "name", times.elapsed("optimeDate", "primary_optime", "exact").alias("lag_seconds"))
    )


# Fixed value: name of the index every collection has.
ID_INDEX = "_id_"


def index_usage_join(indexes: DataFrame, usage: DataFrame, by: Iterable[str] | None = None) -> DataFrame:
    """Index definitions with their accesses; unused means known and zero."""
    keys = [*names(by), "collection", "name"]
    return (
        indexes.join(usage.select(*keys, "ops", "since", F.lit(True).alias("_known")), keys, "left")
        .withColumn("stats_available", F.col("_known").isNotNull())
        .withColumn("accesses", F.when(F.col("_known"), F.coalesce("ops", F.lit(0))))
        .withColumn("unused", F.coalesce((F.col("accesses") == 0) & (F.col("name") != ID_INDEX), F.lit(False)))
        .drop("_known", "ops")
    )


def merge_object_facts(stats: DataFrame, settings: DataFrame, mappings: DataFrame, health: DataFrame,
                       defaults: Mapping[str, object], key: str = "name", by: Iterable[str] | None = None,
                       include_hidden: bool = False, ordered: bool = True) -> DataFrame:
    """Statistics, settings, mapping and health of an object in one row, largest first."""
    keys = [*names(by), key]
    base = stats if include_hidden else stats.filter(~F.col(key).startswith("."))
    for other in (settings, mappings, health):
        base = base.join(other, keys, "left")
    filled = base.fillna({name: value for name, value in defaults.items() if name in base.columns})
    out = filled.withColumn("store_size_human", sizes.format_bytes("store_size_bytes"))
    return out.orderBy(F.desc_nulls_last("store_size_bytes")) if ordered else out


def exists_check(df: DataFrame, col: str, wanted: Sequence[str]) -> DataFrame:
    """One row per requested name with a flag whether it is present."""
    spark = df.sparkSession
    asked = spark.range(1).select(F.explode(F.array(*[F.lit(name) for name in wanted])).alias("name"))
    found = df.filter(F.col(col).isin(*wanted)).groupBy(F.col(col).alias("name")).agg(F.lit(True).alias("_found"))
    return asked.join(found, "name", "left").select("name", F.col("_found").isNotNull().alias("present"))
