"""Data movement on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import movement as op
from ..workspace import new_dir
from .backup import altered_orders
from .registry import EVENTS_AS_OF, plan


def base_orders(t):
    """Orders as they were: before the urgent ones came."""
    return t.orders.filter(F.col("o_orderpriority") != "1-URGENT")


@plan("k08_table_diff", """
WITH k AS (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'insert' WHEN '2-HIGH' THEN 'delete' WHEN '3-MEDIUM' THEN 'update' END AS change FROM orders)
SELECT change, o_orderkey, CASE WHEN change <> 'delete' THEN o_custkey END AS o_custkey, CASE WHEN change <> 'delete' THEN o_orderstatus END AS o_orderstatus,
  CASE change WHEN 'insert' THEN o_totalprice WHEN 'update' THEN o_totalprice + 1 END AS o_totalprice,
  CASE WHEN change <> 'delete' THEN o_orderdate END AS o_orderdate, CASE WHEN change <> 'delete' THEN o_orderpriority END AS o_orderpriority
FROM k WHERE change IS NOT NULL
""")
def table_diff(t):
    return op.table_diff(base_orders(t), altered_orders(t), ["o_orderkey"])


@plan("k09_apply_changes", """
SELECT o_orderkey, o_custkey, o_orderstatus, CASE o_orderpriority WHEN '3-MEDIUM' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
FROM orders WHERE o_orderpriority <> '2-HIGH'
""")
def apply_changes(t):
    """The diff as a log in which every change is preceded by a contrary one and followed by one too late."""
    diff = op.table_diff(base_orders(t), altered_orders(t), ["o_orderkey"])
    early = diff.withColumns({"change": bands.decode("change", {"delete": "update"}, "delete"), "seq": F.lit(1)})
    final = diff.withColumn("seq", F.lit(2))
    late = final.withColumn("change", F.lit("delete"))
    log = (early.unionByName(final).withColumn("ts", F.lit("2001-01-01").cast("timestamp"))
           .unionByName(late.withColumn("ts", F.lit("2001-02-01").cast("timestamp"))))
    return op.apply_changes(base_orders(t), log, ["o_orderkey"], until="2001-01-15")


@plan("k10_reindex", """
SELECT 'completed' AS status, count(*) AS source_rows, count(*) FILTER (event_type = 'error') AS copied_rows FROM events
""")
def reindex(t):
    return op.reindex(t.events, new_dir(t.spark, "reindex"), F.col("event_type") == "error")


@plan("k10_reindex_content", "SELECT * FROM events WHERE event_type = 'error'")
def reindex_content(t):
    path = new_dir(t.spark, "reindex")
    op.reindex(t.events, path, F.col("event_type") == "error")
    return t.spark.read.schema(t.events.schema).parquet(path)


def doubled_orders(t):
    """Orders with an older version of the finished ones."""
    old = t.orders.filter(F.col("o_orderstatus") == "F").withColumns({"o_totalprice": F.lit(0.0), "version": F.lit(1)})
    return t.orders.withColumn("version", F.lit(2)).unionByName(old)


@plan("k11_compact", "SELECT *, 2 AS version FROM orders")
def compact(t):
    src, dst = new_dir(t.spark, "scattered"), new_dir(t.spark, "compact")
    doubled_orders(t).repartition(16).write.parquet(src)
    op.compact(t.spark, src, dst, 2, dedupe_keys=["o_orderkey"], newest=[F.desc("version")])
    return t.spark.read.parquet(dst)


@plan("k11_compact_files", """
SELECT 'before' AS stage, 16::BIGINT AS files FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'after', 2::BIGINT
""")
def compact_files(t):
    src, dst = new_dir(t.spark, "scattered"), new_dir(t.spark, "compact")
    t.orders.repartition(16).write.parquet(src)
    return op.compact(t.spark, src, dst, 2, sort=["o_orderdate", "o_orderkey"]).select("stage", "files")


def jobs_from_events(t):
    return t.events.select(
        F.col("user_id").alias("job_id"), "event_id", "ts",
        bands.decode("event_type", {"purchase": "SUCCESS", "error": "FAILED"}, "IN_PROGRESS").alias("state"),
        F.lit(400).alias("total"), F.floor("value").cast("int").alias("successful"), F.col("props").alias("reason"))


@plan("k12_job_status", """
WITH j AS (SELECT user_id AS job_id, min(ts) AS started, max(ts) AS last_seen, arg_max(event_type, (ts, event_id)) AS et,
             arg_max(value, (ts, event_id)) AS v, arg_max(props, (ts, event_id)) AS reason FROM events GROUP BY user_id),
 s AS (SELECT *, CASE et WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' ELSE 'IN_PROGRESS' END AS state,
   (CASE WHEN et IN ('purchase', 'error') THEN epoch_us(last_seen) ELSE epoch_us(TIMESTAMP '2024-01-31') END - epoch_us(started)) / 1e6::DOUBLE AS secs FROM j)
SELECT job_id, started, last_seen, state, floor(v) * 100 / 400::DOUBLE AS progress_percent, secs AS duration_seconds, reason,
  CASE state WHEN 'SUCCESS' THEN 'success' WHEN 'FAILED' THEN 'failed' ELSE CASE WHEN secs >= 29.9 * 86400 THEN 'timeout' ELSE 'running' END END AS status FROM s
""")
def job_status(t):
    return op.job_status(jobs_from_events(t), EVENTS_AS_OF, timeout=29.9 * 86400, tie=["event_id"])


@plan("k15_copy_tables", """
SELECT 'part' AS "table", count(*) AS rows FROM part UNION ALL SELECT 'pages', count(*) FROM pages
""")
def copy_tables(t):
    path = new_dir(t.spark, "tables")
    tables = {name: getattr(t, name) for name in ("part", "pages", "orders")}
    copied = op.copy_tables(t.spark, tables, path, "pa*")
    counts = [t.spark.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
              for name in ("part", "pages")]
    return copied.select("table").join(counts[0].unionByName(counts[1]), "table")


def event_policies(t):
    return t.events.select("event_type").distinct().filter(F.col("event_type").isin("click", "error")).select(
        "event_type", bands.decode("event_type", {"click": 7}, 20).alias("days"))


@plan("k16_stored_retention", """
SELECT event_id, ts, event_type, value FROM events
WHERE NOT (event_type = 'click' AND ts < TIMESTAMP '2024-01-30 11:00:00' - INTERVAL 7 DAY) AND NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-30 11:00:00' - INTERVAL 20 DAY)
""")
def stored_retention(t):
    path = new_dir(t.spark, "series")
    points = t.events.select("event_id", "ts", "event_type", "value")
    op.write_by_day(points, path, key="event_type")
    op.enforce_stored_retention(t.spark, path, event_policies(t), "2024-01-30 11:00:00", key="event_type", schema=points.schema)
    return t.spark.read.parquet(path).select("event_id", "ts", "event_type", "value")


@plan("k16_retention_actions", """
WITH d AS (SELECT event_type AS series, CAST(ts AS DATE) AS day FROM events GROUP BY ALL),
     l AS (SELECT *, TIMESTAMP '2024-01-30 11:00:00' - CASE event_type WHEN 'click' THEN INTERVAL 7 DAY WHEN 'error' THEN INTERVAL 20 DAY END AS oldest FROM (SELECT DISTINCT event_type FROM events))
SELECT series, day, CASE WHEN oldest IS NULL OR day >= oldest THEN 'keep' WHEN day + INTERVAL 1 DAY <= oldest THEN 'drop' ELSE 'rewrite' END AS action
FROM d JOIN l ON event_type = series
""")
def retention_actions(t):
    path = new_dir(t.spark, "series")
    op.write_by_day(t.events.select("event_id", "ts", "event_type", "value"), path, key="event_type")
    return op.enforce_stored_retention(t.spark, path, event_policies(t), "2024-01-30 11:00:00", key="event_type").select("series", "day", "action")


@plan("k16_enforce_series_retention", """
SELECT event_id, ts, event_type, value FROM events
WHERE NOT (event_type = 'click' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AND NOT (event_type = 'error' AND ts < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY)
""")
def enforce_series_retention(t):
    policies = t.events.select("event_type").distinct().filter(F.col("event_type").isin("click", "error")).select(
        "event_type", bands.decode("event_type", {"click": 7}, 20).alias("days"))
    points = t.events.select("event_id", "ts", "event_type", "value")
    return op.enforce_series_retention(points, policies, EVENTS_AS_OF, key="event_type")
