"""Table data at scale: fingerprints, diff, change logs, reindex, compaction, retention."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import (
    ArrayType, DataType, DateType, IntegerType, IntegralType, MapType, StructField, StructType, TimestampNTZType, TimestampType,
)

from ..functions import times
from ..functions.columns import names
from ..functions.text import glob_regex
from ..workspace import new_dir, observed, side_by_side
from ..sources.files import directory_sizes, file_inventory, inventory_total
from .ordering import latest_n


def quoted(name: str) -> str:
    """A column name as an expression reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def _hash_inputs(col: Column, kind: DataType) -> list[Column]:
    """A value as hash inputs that tell its place: a NULL flag before it, its size before nested values.

    A hash skips NULL and runs nested values together, so bare values could
    move to a neighbouring column unseen.
    """
    if isinstance(kind, StructType):
        return [col.isNull(), *[part for f in kind.fields for part in _hash_inputs(col.getField(f.name), f.dataType)]]
    if isinstance(kind, ArrayType):
        return [col.isNull(), F.size(col), F.transform(col, lambda x: F.xxhash64(*_hash_inputs(x, kind.elementType)))]
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(col), lambda e: F.xxhash64(
            *_hash_inputs(e["key"], kind.keyType), *_hash_inputs(e["value"], kind.valueType)))
        return [col.isNull(), F.size(col), F.array_sort(entries)]
    return [col.isNull(), col]


def row_hash(df: DataFrame, cols: Sequence[str], seed: int = 0) -> Column:
    """Hash of some columns that sees where a value or a NULL stands; each seed gives another hash."""
    parts = [part for name in cols for part in _hash_inputs(F.col(quoted(name)), df.schema[name].dataType)]
    return F.xxhash64(F.lit(seed), *parts)


def fingerprint_columns(df: DataFrame) -> list[Column]:
    """Rows and order-free checksums of two hashes: xor alone would cancel duplicates, so there is a sum too."""
    return [
        F.count("*").alias("rows"), F.bit_xor(row_hash(df, df.columns)).alias("checksum_xor"),
        F.sum(row_hash(df, df.columns, 1).cast("decimal(20,0)")).alias("checksum_sum"),
    ]


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and checksums of a table, in one row and one pass."""
    return df.agg(*fingerprint_columns(df))


def verify_copy(source: DataFrame, copy: DataFrame, table: str) -> DataFrame:
    """Whether a copy holds the same rows as its source."""
    both = fingerprint(source).withColumn("_side", F.lit("source")).unionByName(
        fingerprint(copy.select(*map(quoted, source.columns))).withColumn("_side", F.lit("copy")))

    def of(side: str, col: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(col)))

    def agree(col: str) -> Column:
        return of("source", col).eqNullSafe(of("copy", col))

    return both.agg(
        F.lit(table).alias("table"), of("source", "rows").alias("source_rows"), of("copy", "rows").alias("copy_rows"),
        agree("rows").alias("rows_match"), (agree("checksum_xor") & agree("checksum_sum")).alias("content_matches"))


def table_diff(base: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows inserted, updated or deleted since a base; keys are unique on both sides, NULL is a key like others.

    The base travels as key and two row hashes only. A deleted row shows its
    key and NULL elsewhere.
    """
    rest = [c for c in current.columns if c not in keys]
    old = base.select(*_old_keys(keys), *_hashes(base, rest, "_old"), F.lit(True).alias("_was"))
    new = current.select("*", *_hashes(current, rest, "_new"), F.lit(True).alias("_is"))
    change = (
        F.when(F.col("_was").isNull(), F.lit("insert")).when(F.col("_is").isNull(), F.lit("delete"))
        .when((F.col("_old0") != F.col("_new0")) | (F.col("_old1") != F.col("_new1")), F.lit("update"))
    )
    joined = new.join(old, _same_keys(keys), "full").withColumn("change", change)
    return joined.filter(F.col("change").isNotNull()).select("change", *_either_key(keys), *map(quoted, rest))


def _hashes(df: DataFrame, cols: Sequence[str], name: str) -> list[Column]:
    return [row_hash(df, cols, seed).alias(f"{name}{seed}") for seed in (0, 1)]


def _old_keys(keys: Sequence[str]) -> list[Column]:
    return [F.col(quoted(key)).alias(f"_key{i}") for i, key in enumerate(keys)]


def _same_keys(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(quoted(key)).eqNullSafe(F.col(f"_key{i}")) for i, key in enumerate(keys)])


def _either_key(keys: Sequence[str]) -> list[Column]:
    return [F.coalesce(quoted(key), f"_key{i}").alias(key) for i, key in enumerate(keys)]


def key_place(df: DataFrame, keys: Sequence[str]) -> Column:
    """Where a row stands in a hash tree: a whole number or an instant by itself, any other key by its hash; never NULL."""
    kind = df.schema[keys[0]].dataType if len(keys) == 1 else None
    key = F.col(quoted(keys[0]))
    if isinstance(kind, IntegralType):
        place = key.cast("long")
    elif isinstance(kind, DateType):
        place = F.unix_date(key).cast("long")
    elif isinstance(kind, (TimestampType, TimestampNTZType)):
        place = F.unix_micros(key.cast("timestamp"))
    else:
        return row_hash(df, keys)
    return F.coalesce(place, F.lit(-(1 << 62)))


def hash_tree(df: DataFrame, keys: Sequence[str], width: int = 1024, fan: int = 64, levels: int = 4) -> DataFrame:
    """Rows (level, node, rows, checksum_xor, checksum_sum): fingerprints of a table by nested key ranges, in one pass.

    Level 0 has ranges of ``width`` places, each level above joins ``fan`` of
    the level below; only fingerprints of level 0 see rows. The tree may be kept
    beside a table, so that the table need not be read again to be compared.
    """
    place = key_place(df, keys)
    leaves = df.groupBy(F.floor(place / F.lit(width)).cast("long").alias("node")).agg(*fingerprint_columns(df))
    path = new_dir(df.sparkSession, "tree")
    leaves.withColumn("level", F.lit(0)).write.partitionBy("level").parquet(path)
    schema = StructType([*leaves.schema.fields, StructField("level", IntegerType())])
    for level in range(1, levels):
        below = df.sparkSession.read.schema(schema).parquet(path).filter(F.col("level") == level - 1)
        below.groupBy(F.floor(F.col("node") / F.lit(fan)).cast("long").alias("node")).agg(
            F.sum("rows").alias("rows"), F.bit_xor("checksum_xor").alias("checksum_xor"),
            F.sum("checksum_sum").cast(schema["checksum_sum"].dataType).alias("checksum_sum")).withColumn(
            "level", F.lit(level)).write.mode("append").partitionBy("level").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def compare_trees(source: DataFrame, copy: DataFrame, width: int = 1024, fan: int = 64) -> DataFrame:
    """Rows (range_from, range_to, source_rows, copy_rows) of the smallest ranges in which two tables differ.

    Compared from the top: only children of nodes that differ are looked at on
    the next level, and nothing below a level without a difference.
    """
    spark = source.sparkSession
    level = source.select("level").unionByName(copy.select("level")).agg(F.max("level")).first()[0]
    differs = None
    while level is not None and level >= 0:
        both = source.filter(F.col("level") == level).withColumn("side", F.lit(0)).unionByName(
            copy.filter(F.col("level") == level).withColumn("side", F.lit(1)))
        if differs is not None:
            both = both.join(differs.select(F.col("node").alias("above")), F.floor(F.col("node") / F.lit(fan)) == F.col("above"), "left_semi")

        def of(side: int, name: str) -> Column:
            return F.max(F.when(F.col("side") == side, F.col(name)))
        unlike = reduce(lambda a, b: a | b, [~of(0, name).eqNullSafe(of(1, name)) for name in ("rows", "checksum_xor", "checksum_sum")])
        found = both.groupBy("node").agg(unlike.alias("unlike"), F.coalesce(of(0, "rows"), F.lit(0)).alias("source_rows"),
                                         F.coalesce(of(1, "rows"), F.lit(0)).alias("copy_rows")).filter("unlike").drop("unlike")
        path = new_dir(spark, "unlike")
        found.write.parquet(path)
        differs = spark.read.schema(found.schema).parquet(path)
        if level == 0 or differs.isEmpty():
            return differs.select((F.col("node") * width).alias("range_from"), (F.col("node") * width + width).alias("range_to"), "source_rows", "copy_rows")
        level -= 1
    return spark.createDataFrame([], "range_from long, range_to long, source_rows long, copy_rows long")


def locate_difference(source: DataFrame, copy: DataFrame, keys: Sequence[str], width: int = 1024, fan: int = 64) -> DataFrame:
    """The key ranges in which a copy differs from its source, each table read once; none if they are equal.

    Ranges are of the key if it is one whole number, day or instant (in days or
    microseconds), else of the key's hash. NULL keys are a range of their own.
    """
    return compare_trees(*[hash_tree(df.select(*map(quoted, source.columns)), keys, width, fan) for df in (source, copy)], width, fan)


def ranged_diff(base: DataFrame, current: DataFrame, keys: Sequence[str], width: int = 1024, fan: int = 64) -> DataFrame:
    """``table_diff`` of the rows in the ranges that differ; of equal tables no row is read twice."""
    ranges = locate_difference(base, current, keys, width, fan)
    bounds = ranges.agg(F.min("range_from"), F.max("range_to")).first()
    if bounds[0] is None:
        return table_diff(base.filter(F.lit(False)), current.filter(F.lit(False)), keys)

    def suspects(df: DataFrame) -> DataFrame:
        place = key_place(df, keys)
        near = df.filter(place.between(*bounds)).withColumn("_range", F.floor(place / F.lit(width)).cast("long") * width)
        return near.join(ranges.select(F.col("range_from").alias("_range")), "_range", "left_semi").drop("_range")
    return table_diff(suspects(base), suspects(current), keys)


def apply_changes(base: DataFrame, log: DataFrame, keys: Sequence[str], until: times.Instant | None = None,
                  ts: str = "ts", seq: str = "seq", op: str = "change") -> DataFrame:
    """Replay a change log up to an instant: the last change of a key wins, deletes drop it.

    The log is reduced to its last change per key, combined on the map side,
    and joined once. NULL is a key like others; a change of no kind drops its row.
    """
    changes = log if until is None else log.filter(F.col(ts) <= times.instant_like(log, ts, until))
    whole = F.struct(*[F.col(quoted(c)) for c in base.columns], F.col(quoted(op)).alias("_op"))
    last = changes.groupBy(*_old_keys(keys)).agg(F.max_by(whole, F.struct(ts, seq)).alias("_last"))
    joined = base.withColumn("_is", F.lit(True)).join(last, _same_keys(keys), "full")
    changed = F.col("_last").isNotNull()
    return joined.filter(~changed | (F.col("_last._op") != "delete")).select(*[
        F.when(changed, F.col("_last").getField(c)).otherwise(F.col(quoted(c))).alias(c) for c in base.columns])


def reindex(df: DataFrame, dest: str, where: Column | None = None, fmt: str = "parquet") -> DataFrame:
    """Copy a table, or the rows that meet a condition, and count them on the way."""
    read, written = Observation(), Observation()
    rows = df.observe(read, F.count("*").alias("n"))
    rows = rows if where is None else rows.filter(where)
    rows.observe(written, F.count("*").alias("n")).write.mode("overwrite").format(fmt).save(dest)
    copied = observed(written).get("n", 0)
    source = observed(read).get("n")
    return df.sparkSession.createDataFrame(
        [("completed", df.count() if source is None else source, copied)], "status string, source_rows long, copied_rows long")


def compacted(df: DataFrame, files: int, dedupe_keys: Sequence[str] = (), newest: Sequence[Column] = (),
              sort: Sequence[str] = ()) -> DataFrame:
    """A table in a target number of partitions, with one row per key where asked."""
    rows = latest_n(df, dedupe_keys, list(newest), 1) if dedupe_keys else df
    if sort:
        return rows.repartitionByRange(files, *sort).sortWithinPartitions(*sort)
    return rows.repartition(files, *dedupe_keys) if dedupe_keys else rows.coalesce(files)


def compact(spark: SparkSession, src: str, dst: str, files: int, dedupe_keys: Sequence[str] = (),
            newest: Sequence[Column] = (), sort: Sequence[str] = (), fmt: str = "parquet") -> DataFrame:
    """Rewrite a table into few files; reports files and bytes before and after."""
    source = spark.read.format(fmt).load(src)
    compacted(source, files, dedupe_keys, newest, sort).write.mode("overwrite").format(fmt).save(dst)
    before = inventory_total(file_inventory(spark, src)).withColumn("stage", F.lit("before"))
    after = inventory_total(file_inventory(spark, dst)).withColumn("stage", F.lit("after"))
    return before.unionByName(after).select("stage", "files", "bytes")


def copy_tables(spark: SparkSession, tables: Mapping[str, DataFrame], dst: str, pattern: str) -> DataFrame:
    """Copy the tables whose name matches a glob; files and bytes per table."""
    wanted = {name: df for name, df in tables.items() if re.match(glob_regex(pattern), name)}
    if not wanted:
        raise ValueError(f"no table matches {pattern}")
    side_by_side([lambda df=df, name=name: df.write.mode("overwrite").parquet(f"{dst}/{name}")
                  for name, df in wanted.items()])
    sizes = directory_sizes(file_inventory(spark, dst))
    return sizes.select(F.regexp_extract("directory", "([^/]+)$", 1).alias("table"), "files", "bytes")


def enforce_series_retention(points: DataFrame, policies: DataFrame, as_of: times.Instant,
                             key: str = "measurement", ts: str = "ts") -> DataFrame:
    """Points younger than the policy of their series; a series without a policy keeps all."""
    limits = policies.select(key, F.col("days").alias("_days"))
    age = times.seconds_since(ts, as_of)
    keep = F.col("_days").isNull() | (age <= F.col("_days") * 86400)
    return points.join(limits, key, "left").filter(keep).drop("_days").select(*points.columns)


# How Spark writes a missing partition value.
MISSING = "__HIVE_DEFAULT_PARTITION__"


def write_by_day(points: DataFrame, path: str, key: str = "measurement", ts: str = "ts") -> None:
    """Store points in one folder per series and day, for ``enforce_stored_retention``."""
    points.withColumn("day", F.to_date(ts)).write.mode("overwrite").partitionBy(key, "day").parquet(path)


def retention_actions(spark: SparkSession, path: str, policies: DataFrame, as_of: times.Instant, key: str = "measurement") -> DataFrame:
    """Rows (series, day, folder, files, bytes, action) of points stored by series and day, from the names of their files alone.

    ``drop`` where the whole day lies beyond the limit of its series, ``keep``
    where the whole day lies within it or the series has no policy or the points
    no day, ``rewrite`` where the limit falls inside the day.
    """
    def part(name: str) -> Column:
        value = F.regexp_extract("path", f"/{re.escape(name)}=([^/]+)/", 1)
        return F.when(value != MISSING, F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))))
    stored = file_inventory(spark, path).select(
        part(key).alias("series"), part("day").cast("date").alias("day"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "bytes")
    folders = stored.groupBy("series", "day", "folder").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    limits = policies.select(F.col(key).cast("string").alias("series"), F.col("days").alias("_days"))
    # A point is kept up to and including the age of its limit.
    oldest = times.instant(as_of).cast("timestamp") - F.make_dt_interval(F.col("_days").cast("int"))
    begin, end = F.col("day").cast("timestamp"), F.date_add("day", 1).cast("timestamp")
    action = (F.when(F.col("_days").isNull() | F.col("day").isNull() | (begin >= oldest), F.lit("keep"))
              .when(end <= oldest, F.lit("drop")).otherwise(F.lit("rewrite")))
    return folders.join(limits, "series", "left").withColumn("action", action).drop("_days")


def enforce_stored_retention(spark: SparkSession, path: str, policies: DataFrame, as_of: times.Instant,
                             key: str = "measurement", ts: str = "ts", schema: StructType | None = None) -> DataFrame:
    """Remove what is older than its series' policy from points stored by series and day; returns what was done.

    Files wholly within or beyond a limit are not opened: their folders stay or
    go. Without the points' ``schema`` the footer of one file is read for it. The one day of a series that its limit falls into is read and replaced
    by dynamic partition overwrite, which commits when all of it is written. A
    run that was cut off can be repeated. Folders go one by one on the driver,
    as their names come; nothing is collected.
    """
    def stored(df: DataFrame, label: str) -> DataFrame:
        to = new_dir(spark, label)
        df.write.parquet(to)
        return spark.read.schema(df.schema).parquet(to)
    actions = stored(retention_actions(spark, path, policies, as_of, key), "retention")
    gone = actions.filter(F.col("action") == "drop").select("folder")
    straddling = actions.filter(F.col("action") == "rewrite")
    # At most one folder a series: paths to read, which Spark lists on the driver anyway.
    folders = [row.folder for row in straddling.select("folder").collect()]
    if folders:
        typed = spark.read if schema is None else spark.read.schema(StructType([*schema.fields, StructField("day", DateType())]))
        points = typed.option("basePath", path).parquet(*folders)
        kept = stored(enforce_series_retention(points, policies, as_of, key, ts).select(*points.columns), "young")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key, "day").parquet(path)
        # A day whose points all were too old is not overwritten by any: it goes too.
        left = kept.select(F.col(key).cast("string").alias("series"), "day").distinct()
        gone = gone.unionByName(straddling.join(left, ["series", "day"], "left_anti").select("folder"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for row in gone.toLocalIterator():
        folder = hadoop(row.folder)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return actions.drop("folder")


# States that end a job.
TERMINAL = ["SUCCESS", "FAILED"]


def job_status(events: DataFrame, as_of: times.Instant, timeout: float = 3600.0, by: Iterable[str] = ("job_id",),
               tie: Sequence[str] = ()) -> DataFrame:
    """Latest state, progress and duration per job, and whether it ran out of time."""
    keys = names(by)
    rank = F.struct("ts", *tie)
    jobs = events.groupBy(*keys).agg(
        F.min("ts").alias("started"), F.max("ts").alias("last_seen"),
        F.max(F.struct(rank.alias("at"), "state", "total", "successful", "reason")).alias("last"))
    state = F.col("last.state")
    running_seconds = F.when(state.isin(*TERMINAL), times.elapsed("started", "last_seen", "exact")).otherwise(
        times.seconds_since("started", as_of))
    ended = F.col("state")
    status = (
        F.when(ended == "SUCCESS", F.lit("success")).when(ended == "FAILED", F.lit("failed"))
        .when(F.col("duration_seconds") >= timeout, F.lit("timeout")).otherwise(F.lit("running"))
    )
    return jobs.select(
        *keys, "started", "last_seen", state.alias("state"),
        F.try_divide(F.col("last.successful") * 100.0, F.col("last.total").cast("double")).alias("progress_percent"),
        running_seconds.alias("duration_seconds"), F.col("last.reason").alias("reason"),
    ).withColumn("status", status)
