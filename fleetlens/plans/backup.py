"""Backup catalogs, retention and restore planning on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import backup as op, integrity, movement
from ..sources import exports
from ..workspace import new_dir
from .joins import orders_with_gaps
from .registry import ORDERS_AS_OF, plan
from .shapes import backup_sets


@plan("k01_backup_catalog", """
SELECT 'nightly' AS name, 'success' AS status, true AS has_schema, true AS has_data, 2::BIGINT AS tables,
  (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) AS rows, true AS dated, NULL::BIGINT AS size_bytes
UNION ALL SELECT 'schema-only', 'success', true, false, 1::BIGINT, 0::BIGINT, true, NULL
UNION ALL SELECT 'strange', 'Unknown', false, true, NULL, NULL, false, CAST(sum(length(s_name) + 1) AS BIGINT) FROM supplier
""")
def backup_catalog(t):
    """Exports carry the instant they began; the size is compared where files hold nothing but the rows."""
    root = new_dir(t.spark, "catalog")
    began = t.spark.range(1).select(F.current_timestamp().alias("at")).first().at
    exports.export_database(t.spark, {"orders": t.orders, "customer": t.customer}, f"{root}/nightly", "nightly")
    exports.export_database(t.spark, {"events": t.events}, f"{root}/schema-only", "schema-only", include_data=False)
    t.supplier.select("s_name").write.text(f"{root}/strange/data/supplier")
    dated = F.coalesce(F.col("created_at").cast("timestamp") >= F.lit(began), F.lit(False))
    known = F.col("name") == "strange"
    return op.backup_catalog(t.spark, root).withColumns({"dated": dated, "size_bytes": F.when(known | (F.col("size_bytes") <= 0), F.col("size_bytes"))}).drop(
        "created_at")


@plan("k02_retention_plan", """
SELECT o_orderkey AS backup_id, (epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate))::DOUBLE AS age_seconds, o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 365 DAY AS expired FROM orders
""")
def retention_plan(t):
    return op.retention_plan(backup_sets(t), ORDERS_AS_OF, 365).select("backup_id", "age_seconds", "expired")


@plan("k02_retention_counts", """
SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'D' WHEN '2-HIGH' THEN 'I' ELSE 'L' END AS type, count(*) AS backups,
  count(*) FILTER (date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') > 365) AS expired,
  CAST(sum(CASE WHEN date_diff('day', o_orderdate, TIMESTAMP '2001-08-01') > 365 THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS BIGINT) AS expired_bytes
FROM orders GROUP BY 1
""")
def retention_counts(t):
    return op.retention_counts(op.retention_plan(backup_sets(t), ORDERS_AS_OF, 365, rule="mtime_days"), ["type"])


@plan("k03_retention_audit", """
SELECT c_custkey AS database, max(o_orderdate) FILTER (o_orderstatus = 'F') AS last_success,
  count(o_orderkey) FILTER (o_orderdate < TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) AS obsolete,
  count(o_orderkey) FILTER (o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY) = 0 AS needs_backup
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def retention_audit(t):
    catalog = backup_sets(t).withColumn("status", bands.decode("status", {"F": "Success"}, "Failed"))
    return op.retention_audit(catalog, t.customer.select(F.col("c_custkey").alias("database")), 90, ORDERS_AS_OF)


@plan("k04_backup_status", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'timeout' WHEN o_orderstatus = 'F' THEN 'failed'
  WHEN o_orderpriority = '1-URGENT' THEN 'partial' WHEN o_orderpriority = '2-HIGH' THEN 'completed_with_errors' ELSE 'success' END AS status FROM orders
""")
def backup_status(t):
    priority = F.col("o_orderpriority")
    runs = t.orders.select(
        "o_orderkey", (priority == "5-LOW").alias("timed_out"),
        F.when(F.col("o_orderstatus") == "F", F.lit("disk full")).alias("failure"),
        F.lit(True).alias("schema_backup"), (priority != "1-URGENT").alias("data_copied"),
        F.when(priority == "2-HIGH", F.array(F.lit("bad table"))).alias("errors"))
    return op.backup_status(runs).select("o_orderkey", "status")


@plan("k05_build_manifest", """
SELECT o_custkey AS backup_name, count(*) AS tables, count(*) FILTER (floor(o_totalprice) > 100000) AS data_files,
  CAST(sum(CASE WHEN floor(o_totalprice) > 100000 THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS rows,
  count(*) FILTER (o_orderstatus = 'F') AS errors, min(o_orderdate) AS started_at, max(o_orderdate) AS completed_at,
  CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'completed_with_errors' ELSE 'success' END AS status
FROM orders GROUP BY o_custkey
""")
def build_manifest(t):
    price = F.floor("o_totalprice").cast("long")
    results = t.orders.select(
        F.col("o_custkey").alias("backup_name"), F.when(price > 100000, price).otherwise(0).alias("rows"),
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).alias("error"),
        F.col("o_orderdate").alias("started_at"), F.col("o_orderdate").alias("completed_at"))
    return op.build_manifest(results)


@plan("k05_without_secrets", """
SELECT user_id, event_id, 'user' AS name, event_type AS value FROM events
""")
def without_secrets(t):
    config = F.create_map(F.lit("user"), "event_type", F.lit("db_password"), "props", F.lit("api_token"), "props")
    return t.events.select("user_id", "event_id", F.explode(op.without_secrets(config)).alias("name", "value"))


def altered_orders(t):
    """Orders as they are now: the high-priority ones are gone, the medium ones cost one more."""
    priority = F.col("o_orderpriority")
    price = F.when(priority == "3-MEDIUM", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return t.orders.filter(priority != "2-HIGH").withColumn("o_totalprice", price)


@plan("k06_verify_copy", """
SELECT 'orders' AS "table", count(*) AS source_rows, count(*) AS copy_rows, true AS rows_match, true AS content_matches FROM orders
UNION ALL SELECT 'altered', count(*), count(*) FILTER (o_orderpriority <> '2-HIGH'), false, false FROM orders
UNION ALL SELECT 'repriced', count(*), count(*), true, false FROM orders
""")
def verify_copy(t):
    path = new_dir(t.spark, "copy")
    t.orders.write.parquet(path)
    good = movement.verify_copy(t.orders, t.spark.read.schema(t.orders.schema).parquet(path), "orders")
    bad = movement.verify_copy(t.orders, altered_orders(t), "altered")
    repriced = t.orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 0, F.lit(0.0)).otherwise(F.col("o_totalprice")))
    return good.unionByName(bad).unionByName(movement.verify_copy(t.orders, repriced, "repriced"))


@plan("k06_verify_header", """
SELECT 'ddl' AS part, true AS valid UNION ALL SELECT 'data', false
""")
def verify_header(t):
    path = new_dir(t.spark, "dump")
    exports.export_sql_dump(t.supplier, "supplier", path)
    checked = op.verify_header(t.spark, path, ["Database Export", "CREATE DATABASE"])
    return checked.groupBy(F.regexp_extract("path", "/(ddl|data)/", 1).alias("part")).agg(F.bool_or("valid").alias("valid"))


def status_dumps(orders, path, rows=500_000):
    """One dump a status, its mark first; no task sorts or writes more than about ``rows`` lines."""
    head = orders.select("o_orderstatus").distinct().withColumns({"n": F.lit(-1).cast("long"), "line": F.lit("-- Database Export")})
    lines = orders.select("o_orderstatus", F.col("o_orderkey").cast("long").alias("n"), F.to_json(F.struct("*")).alias("line"))
    cut = head.unionByName(lines).repartitionByRange(orders.count() // rows + 1, "o_orderstatus", "n")
    cut.sortWithinPartitions("o_orderstatus", "n").select("o_orderstatus", "line").write.partitionBy("o_orderstatus").text(path)


@plan("k06_header_bytes", """
SELECT o_orderstatus AS status, true AS marked, true AS bounded FROM orders GROUP BY o_orderstatus
""")
def header_bytes(t):
    """Dumps of all orders, one per status: however long they are, at most 64 KiB of a file are read.

    A dump is a run of files in the order of their names, sorted throughout; the first one holds the mark.
    """
    path = new_dir(t.spark, "dumps")
    status_dumps(t.orders, path)
    checked = op.verify_header(t.spark, path, ["Database Export"])
    return checked.groupBy(F.regexp_extract("path", "/o_orderstatus=([^/]+)/", 1).alias("status")).agg(
        F.min_by("valid", "path").alias("marked"), F.bool_and(F.col("read_bytes") <= 64 << 10).alias("bounded"))


@plan("k06_locate_difference", """
WITH c AS (SELECT o_orderkey, o_orderkey // 256 AS node, o_custkey % 97 = 5 AS gone, o_orderkey % 1999 < 2 AS changed FROM orders)
SELECT CAST(node * 256 AS BIGINT) AS range_from, CAST(node * 256 + 256 AS BIGINT) AS range_to, count(*) AS source_rows, count(*) FILTER (NOT gone) AS copy_rows
FROM c GROUP BY node HAVING bool_or(gone OR changed)
""")
def locate_difference(t):
    return movement.locate_difference(t.orders, scratched_orders(t), ["o_orderkey"], width=256, fan=16)


@plan("k08_ranged_diff", """
SELECT CASE WHEN o_custkey % 97 = 5 THEN 'delete' ELSE 'update' END AS change, o_orderkey, CASE WHEN o_custkey % 97 <> 5 THEN o_custkey END AS o_custkey,
  CASE WHEN o_custkey % 97 <> 5 THEN o_totalprice + 1 END AS o_totalprice
FROM orders WHERE o_custkey % 97 = 5 OR o_orderkey % 1999 < 2
""")
def ranged_diff(t):
    return movement.ranged_diff(t.orders, scratched_orders(t), ["o_orderkey"], width=256, fan=16).select(
        "change", "o_orderkey", "o_custkey", "o_totalprice")


def scratched_orders(t):
    """A copy of the orders without some customers' and with some prices changed."""
    changed = F.col("o_orderkey") % 1999 < 2
    return t.orders.filter(F.col("o_custkey") % 97 != 5).withColumn(
        "o_totalprice", F.when(changed, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))


@plan("k06_verify_not_empty", """
SELECT 3::BIGINT AS files, CAST(sum(length(o_orderkey::VARCHAR) + 1) AS BIGINT) AS bytes, count(*) > 0 AS not_empty FROM orders
""")
def verify_not_empty(t):
    path = new_dir(t.spark, "copy")
    t.orders.select(F.col("o_orderkey").cast("string").alias("value")).repartition(3).write.text(path)
    return op.verify_not_empty(t.spark, path).select("files", "bytes", "not_empty")


CHAIN_SQL = """
b AS (SELECT o_custkey AS database, o_orderkey AS id, o_orderdate AS st, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes,
             CASE o_orderpriority WHEN '1-URGENT' THEN 'D' WHEN '2-HIGH' THEN 'I' ELSE 'L' END AS type FROM orders),
 logs AS (SELECT *, date_diff('second', lag(st + INTERVAL 1 HOUR) OVER (PARTITION BY database ORDER BY st, id), st) > 200 * 86400 AS gap FROM b WHERE type = 'L'),
 tg AS (SELECT c_custkey AS database, 1 AS target_id, TIMESTAMP '1998-01-01' AS target_ts FROM customer UNION ALL SELECT c_custkey, 2, TIMESTAMP '2001-08-01' FROM customer),
 f AS (SELECT tg.*, max(struct_pack(st := b.st, id := b.id)) AS fb FROM tg LEFT JOIN b ON b.database = tg.database AND b.type = 'D' AND b.st <= tg.target_ts GROUP BY tg.database, tg.target_id, tg.target_ts),
 d AS (SELECT f.database, f.target_id, f.target_ts, f.fb, max(struct_pack(st := b.st, id := b.id)) AS db FROM f LEFT JOIN b ON b.database = f.database AND b.type = 'I' AND b.st <= f.target_ts AND b.st > f.fb.st GROUP BY ALL),
 s AS (SELECT *, coalesce(db.st, fb.st) AS base_ts FROM d)
"""
CHAIN_END = """
SELECT s.database, s.target_id::BIGINT AS target_id, s.target_ts, fb.id AS full_id, db.id AS differential_id, base_ts,
  CASE WHEN base_ts IS NOT NULL THEN count(l.id) END AS logs, CASE WHEN base_ts IS NOT NULL THEN CAST(coalesce(sum(l.bytes), 0) AS BIGINT) END AS log_bytes,
  CASE WHEN base_ts IS NOT NULL THEN count(l.id) FILTER (l.gap) END AS gaps, base_ts IS NOT NULL AS restorable,
  base_ts IS NOT NULL AND count(l.id) FILTER (l.gap) = 0 AS continuous
FROM s LEFT JOIN logs l ON l.database = s.database AND l.st > base_ts AND l.st <= target_ts
GROUP BY s.database, s.target_id, s.target_ts, fb, db, base_ts
"""
CHAINS = f"chains AS (WITH {CHAIN_SQL} SELECT * FROM s WHERE base_ts IS NOT NULL)"


def logged_backups(t):
    return backup_sets(t).withColumn("finished", F.col("created") + F.expr("INTERVAL 1 HOUR"))


@plan("k07_restore_members", f"""
WITH {CHAINS}, l AS (SELECT o_custkey AS database, o_orderkey AS backup_id, o_orderdate AS created FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')),
     m AS (SELECT c.database, c.target_id, backup_id, created FROM chains c JOIN l ON l.database = c.database AND created > base_ts AND created <= target_ts)
SELECT database, CAST(target_id AS BIGINT) AS target_id, backup_id, created FROM m
WHERE (database, target_id) IN (SELECT (database, target_id) FROM m GROUP BY database, target_id HAVING count(*) >= 3)
""")
def restore_members(t):
    """The logs of every target that needs three or more."""
    chain = restore_chain(t)
    return op.restore_members(logged_backups(t), chain.filter(F.col("logs") >= 3), width=30 * 86400.0)


@plan("k07_restore_member_counts", f"""
WITH {CHAINS}
SELECT c.database, CAST(target_id AS BIGINT) AS target_id, TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (epoch_us(o_orderdate) // (7 * 86400000000) * 7) AS span_start,
       count(*) AS logs, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS log_bytes
FROM chains c JOIN orders ON o_custkey = c.database AND o_orderdate > base_ts AND o_orderdate <= target_ts AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')
GROUP BY ALL
""")
def restore_member_counts(t):
    """The chains are computed once and stored: the counts read them several times, and would plan their windows anew each time."""
    path = new_dir(t.spark, "chains")
    chain = restore_chain(t).select("database", "target_id", "base_ts", "target_ts")
    chain.write.parquet(path)
    return op.restore_member_counts(logged_backups(t), t.spark.read.schema(chain.schema).parquet(path), width=7 * 86400.0)


@plan("k07_restore_chain", f"""
WITH {CHAIN_SQL} {CHAIN_END}
""")
def restore_chain(t):
    backups = logged_backups(t)
    wanted = F.array(*[F.struct(F.lit(i).cast("long").alias("target_id"), F.lit(at).cast("timestamp_ntz").alias("target_ts"))
                       for i, at in ((1, "1998-01-01"), (2, "2001-08-01"))])
    targets = t.customer.select(F.col("c_custkey").alias("database"), F.inline(wanted))
    return op.restore_chain(backups, targets, max_gap=200 * 86400.0)


@plan("k13_restore_points", """
SELECT o_custkey AS database, count(*) AS restore_points, max(o_orderdate) AS latest_restorable_time, count(*) FILTER (o_orderstatus = 'P') AS geo_backups FROM orders GROUP BY o_custkey
""")
def restore_points(t):
    points = t.orders.select(F.col("o_custkey").alias("database"), F.col("o_orderdate").alias("created"),
                             bands.decode("o_orderstatus", {"P": "GEO"}, "DISCRETE").alias("type"))
    return op.restore_points(points)


@plan("k14_maintenance_history", """
SELECT l_orderkey * 1000 + l_partkey % 1000 AS log_id, l_shipdate AS execution_date, 's' || l_suppkey || '.' || 't' || l_partkey || '.' || 'i' || l_linenumber AS object_name,
  l_returnflag AS operation, CAST(l_quantity AS DOUBLE) AS frag_before, CAST(l_quantity AS BIGINT) AS duration_seconds, CASE WHEN l_linestatus = 'F' THEN 'Failed' ELSE 'Success' END AS status
FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01' ORDER BY l_shipdate DESC, log_id DESC LIMIT 20
""")
def maintenance_history(t):
    log = t.lineitem.select(
        (F.col("l_orderkey") * 1000 + F.col("l_partkey") % 1000).alias("log_id"), F.col("l_shipdate").alias("execution_date"),
        F.concat(F.lit("s"), "l_suppkey").alias("schema_name"), F.concat(F.lit("t"), "l_partkey").alias("table_name"),
        F.concat(F.lit("i"), "l_linenumber").alias("index_name"), F.col("l_returnflag").alias("operation"),
        F.col("l_quantity").alias("fragmentation_before"), F.col("l_quantity").cast("long").alias("duration_seconds"),
        F.when(F.col("l_linestatus") == "F", F.lit("lock timeout")).alias("error_message"))
    return op.maintenance_history(log, "2001-01-01").withColumn("frag_before", F.col("frag_before").cast("double"))


@plan("k17_integrity_check", """
SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')) + (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_custkey NOT IN (SELECT c_custkey FROM customer)) AS foreign_key_violations,
  (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)) AS unique_violations,
  (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS not_null_violations, 'ISSUES_FOUND' AS status
""")
def integrity_check(t):
    tables = {"lineitem": t.lineitem, "orders": orders_with_gaps(t),
              "customer": t.customer.withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))}
    return integrity.integrity_check(
        tables,
        [integrity.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
         integrity.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",))],
        {"lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"]},
        {"customer": ["c_custkey", "c_mktsegment"]})


@plan("k17_integrity_clean", """
SELECT 0::BIGINT AS foreign_key_violations, 0::BIGINT AS unique_violations, 0::BIGINT AS not_null_violations, 'HEALTHY' AS status FROM region LIMIT 1
""")
def integrity_clean(t):
    tables = {"orders": t.orders, "customer": t.customer, "nation": t.nation, "region": t.region, "part": t.part,
              "lineitem": t.lineitem, "supplier": t.supplier}
    key = integrity.ForeignKey
    return integrity.integrity_check(
        tables,
        [key("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)), key("lineitem", ("l_partkey",), "part", ("p_partkey",)),
         key("lineitem", ("l_suppkey",), "supplier", ("s_suppkey",)), key("orders", ("o_custkey",), "customer", ("c_custkey",)),
         key("customer", ("c_nationkey",), "nation", ("n_nationkey",)), key("nation", ("n_regionkey",), "region", ("r_regionkey",))],
        {"orders": ["o_orderkey"], "customer": ["c_custkey"]}, {"orders": ["o_orderkey", "o_custkey"]})
