"""Backup catalogs, retention and restore planning."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import times
from ..functions.columns import names
from ..functions.text import qualified_name
from ..sources.exports import MANIFEST_SCHEMA
from ..sources.files import file_heads, file_inventory, inventory_total
from .chunks import DAY, range_of, running, time_chunk
from .ordering import top_n

# Spans of one key that are summed up in one task.
SPANS = 4096


def retention_plan(catalog: DataFrame, as_of: times.Instant, days: int, rule: str = "cutoff",
                   created: str = "created") -> DataFrame:
    """Every backup with its age and whether it expires; nothing is deleted.

    ``cutoff``: created before ``as_of - days``. ``mtime_days``: more than
    ``days`` whole days old. A backup without a date never expires.
    """
    age = times.seconds_since(created, as_of)
    expired = {"cutoff": age > days * 86400.0, "mtime_days": F.floor(age / 86400.0) > days}[rule]
    return catalog.withColumns({"age_seconds": age, "expired": F.coalesce(expired, F.lit(False))})


def retention_counts(plan: DataFrame, by: Iterable[str]) -> DataFrame:
    """Backups kept and expired per key, and the bytes to gain."""
    return plan.groupBy(*names(by)).agg(
        F.count("*").alias("backups"), F.count_if(F.col("expired")).alias("expired"),
        F.sum(F.when(F.col("expired"), F.col("bytes")).otherwise(0)).alias("expired_bytes"))


def retention_audit(catalog: DataFrame, objects: DataFrame, days: int, as_of: times.Instant,
                    key: str = "database") -> DataFrame:
    """Objects with their last success, obsolete backups, and whether they need a backup now."""
    plan = retention_plan(catalog, as_of, days)
    good = F.col("status") == "Success"
    per_object = plan.groupBy(key).agg(
        F.max(F.when(good, F.col("created"))).alias("last_success"),
        F.count_if(F.col("expired")).alias("obsolete"),
        F.count_if(good & ~F.col("expired")).alias("recent"))
    audited = objects.join(per_object, key, "left")
    return audited.select(
        *objects.columns, "last_success", F.coalesce("obsolete", F.lit(0)).alias("obsolete"),
        (F.coalesce("recent", F.lit(0)) == 0).alias("needs_backup"))


def backup_status(df: DataFrame) -> DataFrame:
    """Outcome from failure text, flags and error list, since manifests are written before it is known.

    A missing flag counts as false only where the other one is known.
    """
    known = F.col("schema_backup").isNotNull() | F.col("data_copied").isNotNull()
    both = F.coalesce("schema_backup", F.lit(False)) & F.coalesce("data_copied", F.lit(False))
    status = (
        F.when(F.coalesce("timed_out", F.lit(False)), F.lit("timeout"))
        .when(F.col("failure").isNotNull(), F.lit("failed"))
        .when(known & ~both, F.lit("partial"))
        .when(F.coalesce(F.size("errors"), F.lit(0)) > 0, F.lit("completed_with_errors"))
        .otherwise(F.lit("success"))
    )
    return df.withColumn("status", status)


# Fixed value: setting names that must not reach a manifest.
SECRET_NAMES = r"(?i)password|passwd|secret|token|credential"


def without_secrets(config: Column | str) -> Column:
    """Configuration map without entries that hold secrets."""
    return F.map_filter(config, lambda name, _: ~name.rlike(SECRET_NAMES))


def build_manifest(results: DataFrame, by: Iterable[str] = ("backup_name",)) -> DataFrame:
    """Summary row per backup from its per-table results."""
    return results.groupBy(*names(by)).agg(
        F.count("*").alias("tables"), F.count_if(F.col("rows") > 0).alias("data_files"),
        F.sum("rows").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.min("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"),
    ).withColumn("status", F.when(F.col("errors") > 0, F.lit("completed_with_errors")).otherwise(F.lit("success")))


def backup_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Backups under a root: status, start, size, parts present; those without a manifest stay, as Unknown."""
    part = F.regexp_extract("path", f"{_tail(root)}/([^/]+)/([^/]+)/", 1)
    kind = F.regexp_extract("path", f"{_tail(root)}/([^/]+)/([^/]+)/", 2)
    files = file_inventory(spark, root).select(part.alias("name"), kind.alias("kind"), "bytes").filter(F.col("name") != "")
    on_disk = files.groupBy("name").agg(
        F.sum("bytes").alias("size_bytes"), F.count_if(F.col("kind") == "schema").alias("_schema"),
        F.count_if(F.col("kind") == "data").alias("_data"), F.count_if(F.col("kind") == "manifest").alias("_manifest"))
    if files.filter(F.col("kind") == "manifest").isEmpty():
        rows = spark.createDataFrame([], MANIFEST_SCHEMA).withColumn("name", F.lit(""))
    else:
        rows = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/*/manifest").withColumn(
            "name", F.regexp_extract(F.col("_metadata.file_path"), f"{_tail(root)}/([^/]+)/manifest", 1))
    told = build_manifest(rows, by=["name"]).select("name", "status", F.col("started_at").alias("created_at"), "tables", "rows")
    return on_disk.join(told, "name", "full").select(
        "name", F.coalesce("status", F.lit("Unknown")).alias("status"), "created_at",
        F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), (F.col("_schema") > 0).alias("has_schema"),
        (F.col("_data") > 0).alias("has_data"), "tables", "rows",
    ).orderBy(F.desc_nulls_last("created_at"), "name")


def _tail(root: str) -> str:
    """Last folder of a path, quoted for a regular expression."""
    return re.escape(root.rstrip("/").rsplit("/", 1)[-1])


def verify_header(spark: SparkSession, path: str, patterns: Sequence[str], lines: int = 5) -> DataFrame:
    """Whether a dump marker stands in the first lines of each file; only the heads of files are read."""
    def marked(line: Column) -> Column:
        return reduce(lambda a, b: a | b, [line.contains(pattern) for pattern in patterns], F.lit(False))
    return file_heads(spark, path, lines).select("path", F.exists("lines", marked).alias("valid"), "bytes", "read_bytes")


def verify_not_empty(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and whether a backup directory holds anything."""
    return inventory_total(file_inventory(spark, path)).withColumn("not_empty", F.col("files") > 0)


def restore_chain(backups: DataFrame, targets: DataFrame, by: Sequence[str] = ("database",),
                  max_gap: float = 0.0, width: float = DAY) -> DataFrame:
    """What each target instant needs: the latest full backup, a later differential, the logs after.

    Backups and targets are put on one time line per key and scanned once, in
    chunks of ``width`` seconds, so neither a hot database nor many targets multiply the work. The
    logs of a target are those that start after its base and not after it;
    they are given as count, bytes and gaps. A gap is a log that starts more
    than ``max_gap`` seconds after the log before it finished.
    """
    keys = list(by)
    line = _time_line(backups, targets, keys).withColumn("chunk", time_chunk("at", width))
    scanned = _scan_chunks(line, keys, max_gap)
    carried = _carry_chunks(scanned, keys, max_gap)

    def overall(spot: str) -> Column:
        """A base found in this chunk, counted from the start of the line, or the one carried in."""
        return F.coalesce(_from_start(F.col(spot)), F.col(f"{spot}_before"))

    opened = scanned.filter(F.col("type") == "T").join(carried, [*keys, "chunk"], "left").fillna(
        {"logs_before": 0, "bytes_before": 0, "gaps_before": 0, "opening_gap": False})
    placed = opened.select(
        *keys, F.col("id").alias("target_id"), F.col("at").alias("target_ts"),
        _from_start(F.struct("at", "id", "logs", "log_bytes", "gaps", "has_log")).alias("now"),
        overall("full").alias("full"), overall("diff").alias("diff"))
    later = F.col("diff.at") > F.col("full.at")
    chain = placed.withColumn("base", F.when(later, F.col("diff")).otherwise(F.col("full")))
    return chain.select(
        *keys, "target_id", "target_ts", F.col("full.id").alias("full_id"),
        F.when(later, F.col("diff.id")).alias("differential_id"), F.col("base.at").alias("base_ts"),
        *[(F.col(f"now.{name}") - F.col(f"base.{name}")).alias(name) for name in ("logs", "log_bytes", "gaps")],
        F.col("full").isNotNull().alias("restorable"),
    ).withColumn("continuous", F.col("restorable") & (F.col("gaps") == 0))


def _time_line(backups: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Logs, bases and targets in one table; at the same instant they come in that order."""
    is_log = F.col("type") == "L"
    events = backups.filter(F.col("type").isin("D", "I", "L")).select(
        *keys, F.col("created").alias("at"), F.when(is_log, 0).otherwise(1).alias("rank"),
        F.col("backup_id").alias("id"), "type",
        F.when(is_log, F.col("bytes")).otherwise(0).alias("bytes"), F.when(is_log, F.col("finished")).alias("finished"))
    kind = backups.schema["finished"].dataType
    wanted = targets.select(
        *keys, F.col("target_ts").alias("at"), F.lit(2).alias("rank"), F.col("target_id").alias("id"),
        F.lit("T").alias("type"), F.lit(0).cast("long").alias("bytes"), F.lit(None).cast(kind).alias("finished"))
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "at"]])
    return events.unionByName(wanted).filter(complete)


def _scan_chunks(line: DataFrame, keys: Sequence[str], max_gap: float) -> DataFrame:
    """Counts and latest bases up to each row, within its chunk."""
    chunk = Window.partitionBy(*keys, "chunk").orderBy("at", "rank", "id")
    upto = chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = chunk.rowsBetween(Window.unboundedPreceding, -1)
    is_log = F.col("type") == "L"
    counted = line.withColumns({
        "gap": _is_gap(F.last("finished", ignorenulls=True).over(before), F.col("at"), max_gap) & is_log,
        "logs": F.count_if(is_log).over(upto), "log_bytes": F.sum("bytes").over(upto),
        "first_log": F.min(F.when(is_log, F.col("at"))).over(upto),
    }).withColumns({"gaps": F.count_if(F.col("gap")).over(upto), "has_log": F.col("first_log").isNotNull()})
    spot = F.struct("at", "id", "logs", "log_bytes", "gaps", "has_log")
    return counted.withColumns({
        name: F.last(F.when(F.col("type") == kind, spot), ignorenulls=True).over(upto)
        for name, kind in (("full", "D"), ("diff", "I"))})


def _is_gap(finish: Column, start: Column, max_gap: float) -> Column:
    return F.coalesce(times.elapsed(finish, start, "exact") > max_gap, F.lit(False))


def _from_start(spot: Column) -> Column:
    """Counts of a spot within its chunk, lifted by what the chunks before add."""
    opening = F.when(spot["has_log"] & F.col("opening_gap"), 1).otherwise(0)
    return F.when(spot.isNotNull(), F.struct(
        spot["at"].alias("at"), spot["id"].alias("id"), (spot["logs"] + F.col("logs_before")).alias("logs"),
        (spot["log_bytes"] + F.col("bytes_before")).alias("log_bytes"),
        (spot["gaps"] + F.col("gaps_before") + opening).alias("gaps")))


def _carry_chunks(scanned: DataFrame, keys: Sequence[str], max_gap: float) -> DataFrame:
    """What each chunk inherits: counts, bases, and a gap before its first log. One row per key and chunk."""
    chunks = scanned.groupBy(*keys, "chunk").agg(
        F.max("logs").alias("logs"), F.max("log_bytes").alias("log_bytes"), F.max("gaps").alias("gaps"),
        F.min("first_log").alias("first_log"),
        F.max(F.when(F.col("finished").isNotNull(), F.struct("at", "id", "finished"))).alias("last_log"),
        F.max("full").alias("full"), F.max("diff").alias("diff"))
    past = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    opened = chunks.withColumn("opening_gap", _is_gap(
        F.last("last_log.finished", ignorenulls=True).over(past), F.col("first_log"), max_gap))
    all_gaps = F.col("gaps") + F.col("opening_gap").cast("long")
    summed = opened.withColumns({
        "logs_before": F.coalesce(F.sum("logs").over(past), F.lit(0)),
        "bytes_before": F.coalesce(F.sum("log_bytes").over(past), F.lit(0)),
        "gaps_before": F.coalesce(F.sum(all_gaps).over(past), F.lit(0)),
    })
    lifted = summed.withColumns({name: _from_start(F.col(name)) for name in ("full", "diff")})
    return lifted.select(
        *keys, "chunk", "opening_gap", "logs_before", "bytes_before", "gaps_before",
        *[F.last(name, ignorenulls=True).over(past).alias(f"{name}_before") for name in ("full", "diff")])


def restore_members(backups: DataFrame, chain: DataFrame, target_ids: Sequence[int] | None = None,
                    by: Sequence[str] = ("database",), width: float = DAY) -> DataFrame:
    """The log backups a restore needs, in a row each, for all targets of ``chain`` or those named.

    An interval join by spans of ``width`` seconds: a target stands in every
    span its chain reaches into, a log in one, and they meet in that span of
    their database only. So a busy database is shared out by time, and the work
    grows with the logs listed, not with logs times targets.
    """
    keys = list(by)
    wanted = chain if target_ids is None else chain.filter(F.col("target_id").isin(*target_ids))
    return _spanned(wanted, keys, width).join(_logs(backups, keys, width), [*keys, "span"]).filter(
        (F.col("created") > F.col("base_ts")) & (F.col("created") <= F.col("target_ts"))
    ).select(*keys, "target_id", "backup_id", "created")


def restore_member_counts(backups: DataFrame, chain: DataFrame, by: Sequence[str] = ("database",), width: float = DAY) -> DataFrame:
    """Logs and bytes each target needs of every span of ``width`` seconds: rows (by, target_id, span_start, logs, log_bytes).

    Logs are counted per span, and the spans summed up along time. The sums at a
    target's base and instant come from one scan of logs, bases and targets in
    order. A span then holds the difference of two sums, cut off at the base and
    the instant, so no log is set against a target, however many overlap.
    """
    keys = list(by)
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, "base_ts"]])
    targets = chain.filter(complete).select(*keys, "target_id", "base_ts", "target_ts")
    logs = _logs(backups, keys, width)
    ends = targets.select(*keys, "target_id", F.inline(F.array(
        F.struct(F.lit("base").alias("end"), F.col("base_ts").alias("at")), F.struct(F.lit("goal").alias("end"), F.col("target_ts").alias("at")))))
    # At one instant logs come before the ends, as a log that starts at an end belongs before it.
    line = logs.select(*keys, F.col("created").alias("at"), F.lit(0).alias("rank"), F.lit(1).cast("long").alias("one"), "bytes").unionByName(
        ends.withColumns({"rank": F.lit(1), "one": F.lit(0).cast("long"), "bytes": F.lit(0).cast("long")}), allowMissingColumns=True)
    placed = running(line, keys, ["at", "rank"], sums={"logs": F.col("one"), "log_bytes": F.coalesce("bytes", F.lit(0))})

    def at(end: str, name: str) -> Column:
        return F.max(F.when(F.col("end") == end, F.col(name))).alias(f"{end}_{name}")
    sums = placed.filter("rank = 1").groupBy(*keys, "target_id").agg(*[at(end, name) for end in ("base", "goal") for name in ("logs", "log_bytes", "at")])
    counted = logs.groupBy(*keys, "span").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"))
    # A span of a key is one row, so chunks of spans are cut without looking at them.
    spans = running(counted, keys, ["span"], range_of("span", SPANS), sums={"n_end": F.col("n"), "size_end": F.col("size")})
    met = _spanned(sums.withColumnsRenamed({"base_at": "base_ts", "goal_at": "target_ts"}), keys, width).join(spans, [*keys, "span"])

    def within(end: Column, own: str, name: str) -> Column:
        return F.least(end, F.col(f"goal_{name}")) - F.greatest(end - F.col(own), F.col(f"base_{name}"))
    return met.select(
        *keys, "target_id", F.timestamp_seconds(F.col("span") * width).cast(backups.schema["created"].dataType).alias("span_start"),
        within(F.col("n_end"), "n", "logs").alias("logs"), within(F.col("size_end"), "size", "log_bytes").alias("log_bytes")).filter("logs > 0")


def _logs(backups: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    logs = backups.filter((F.col("type") == "L") & F.col("created").isNotNull())
    return logs.select(*keys, "backup_id", "created", F.col("bytes").cast("long").alias("bytes"), time_chunk("created", width).alias("span"))


def _spanned(targets: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Targets with a base, once for every span between it and their instant."""
    known = targets.filter(F.col("base_ts").isNotNull() & (F.col("target_ts") >= F.col("base_ts")))
    return known.withColumn("span", F.explode(F.sequence(time_chunk("base_ts", width), time_chunk("target_ts", width))))


def restore_points(points: DataFrame, by: Iterable[str] = ("database",)) -> DataFrame:
    """Number of restore points per database, the latest one, and geo-replicated ones."""
    return points.groupBy(*names(by)).agg(
        F.count("*").alias("restore_points"), F.max("created").alias("latest_restorable_time"),
        F.count_if(F.col("type") == "GEO").alias("geo_backups"))


def maintenance_history(log: DataFrame, since: times.Instant, n: int = 20, by: Iterable[str] | None = None) -> DataFrame:
    """Latest maintenance operations with their outcome, ``n`` per server where ``by`` names its keys."""
    wanted = log.filter(F.col("execution_date") >= times.instant_like(log, "execution_date", since))
    return top_n(wanted, [F.desc("execution_date"), F.desc("log_id")], n, by).select(
        *names(by), "log_id", "execution_date", qualified_name("schema_name", "table_name", "index_name").alias("object_name"),
        "operation", F.col("fragmentation_before").cast("decimal(5,2)").alias("frag_before"), "duration_seconds",
        F.when(F.col("error_message").isNull(), F.lit("Success")).otherwise(F.lit("Failed")).alias("status"))
