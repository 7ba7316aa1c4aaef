"""Joins on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands
from ..operators import integrity, joins as op
from .registry import ORDERS_AS_OF, plan


def locks_from_orders(t):
    """Orders as lock requests on their customer; urgent ones wait."""
    nothing = F.lit(None).cast("long")
    return t.orders.select(
        F.col("o_orderkey").alias("pid"), F.lit("relation").alias("locktype"), nothing.alias("database"),
        F.col("o_custkey").alias("relation"), nothing.alias("page"), nothing.alias("tuple"),
        F.nullif("o_orderstatus", F.lit("F")).alias("virtualxid"), nothing.alias("transactionid"),
        nothing.alias("classid"), nothing.alias("objid"), nothing.alias("objsubid"),
        (F.col("o_orderpriority") != "1-URGENT").alias("granted"), F.col("o_orderpriority").alias("mode"),
    )


def sessions_of_orders(t):
    return t.orders.select(
        F.col("o_orderkey").alias("pid"), F.concat(F.lit("user"), F.col("o_custkey")).alias("usename"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("query"), F.col("o_orderdate").alias("query_start"),
    )


@plan("c01_blocking_pairs", """
WITH l AS (SELECT o_orderkey AS pid, o_custkey AS relation, nullif(o_orderstatus, 'F') AS virtualxid,
                  o_orderpriority = '1-URGENT' AS waits FROM orders),
     g AS (SELECT relation, virtualxid, count(*) AS held, count(*) FILTER (waits) AS waiting FROM l GROUP BY ALL),
     r AS (SELECT l.*, held - 1 AS blockers, waiting - CAST(waits AS BIGINT) AS waiters
           FROM l JOIN g ON l.relation = g.relation AND l.virtualxid IS NOT DISTINCT FROM g.virtualxid
           WHERE waiting > 0)
SELECT relation, virtualxid, pid, 'user' || relation AS usename, 'order ' || pid AS statement, 'blocked' AS role, 1::BIGINT AS requests, blockers AS partners
FROM r WHERE waits AND blockers > 0
UNION ALL
SELECT relation, virtualxid, pid, 'user' || relation, 'order ' || pid, 'blocking', 1, waiters FROM r WHERE waiters > 0
""")
def blocking_pairs(t):
    return op.lock_contention(locks_from_orders(t), sessions_of_orders(t)).select(
        "relation", "virtualxid", "pid", "usename", "statement", "role", "requests", "partners")


@plan("c01_blocking_pairs_of_waiters", """
WITH l AS (SELECT o_orderkey AS pid, o_custkey AS relation, nullif(o_orderstatus, 'F') AS virtualxid,
                  o_orderpriority = '1-URGENT' AS waits FROM orders),
     named AS (SELECT pid FROM l WHERE waits AND (SELECT count(*) FROM l h WHERE h.relation = l.relation AND h.virtualxid IS NOT DISTINCT FROM l.virtualxid) <= 4)
SELECT w.pid AS blocked_pid, 'user' || w.relation AS blocked_user, h.pid AS blocking_pid, 'user' || h.relation AS blocking_user,
  'order ' || w.pid AS blocked_statement, 'order ' || h.pid AS blocking_statement, 1::BIGINT AS pairs
FROM l w JOIN l h ON w.relation = h.relation AND w.virtualxid IS NOT DISTINCT FROM h.virtualxid AND w.pid <> h.pid
WHERE w.pid IN (SELECT pid FROM named)
""")
def blocking_pairs_of_waiters(t):
    """Who blocks the sessions that at most three requests stand in the way of."""
    contention = op.lock_contention(locks_from_orders(t), sessions_of_orders(t))
    return op.blocking_pairs(contention, F.col("partners") <= 3)


@plan("c02_lock_waiters", """
SELECT c_mktsegment AS schemaname, c_name AS tablename, 'relation' AS locktype, o_orderpriority AS mode,
       false AS granted, 'user' || o_custkey AS usename, 'order ' || o_orderkey AS query, o_orderdate AS query_start,
       CAST(epoch(TIMESTAMP '2001-08-01') - epoch(o_orderdate) AS DOUBLE) AS age_seconds
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'
""")
def lock_waiters(t):
    tables = t.customer.select(F.col("c_custkey").alias("relid"), F.col("c_mktsegment").alias("schemaname"),
                               F.col("c_name").alias("tablename"))
    return op.lock_waiters(tables, locks_from_orders(t), sessions_of_orders(t), ORDERS_AS_OF, ordered=False)


@plan("c03_resolve_objects", """
SELECT r_name AS schema_name, n_name AS table_name, s_name AS index_name, count(*) AS lines,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS pages
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name, s_name
""")
def resolve_objects(t):
    per_supplier = t.lineitem.groupBy(F.col("l_suppkey").alias("index_id")).agg(
        F.count("*").alias("lines"), F.sum(F.col("l_quantity").cast("long")).alias("pages"))
    homes = t.supplier.select(F.col("s_suppkey").alias("index_id"), F.col("s_nationkey").alias("object_id"))
    stats = per_supplier.join(homes, "index_id")
    indexes = t.supplier.select(F.col("s_nationkey").alias("object_id"), F.col("s_suppkey").alias("index_id"),
                                F.col("s_name").alias("name"), F.lit(False).alias("is_disabled"))
    tables = t.nation.select(F.col("n_nationkey").alias("object_id"), F.col("n_name").alias("name"),
                             F.col("n_regionkey").alias("schema_id"), F.lit(False).alias("is_ms_shipped"))
    schemas = t.region.select(F.col("r_regionkey").alias("schema_id"), F.col("r_name").alias("name"))
    return op.resolve_objects(stats, indexes, tables, schemas).select(
        "schema_name", "table_name", "index_name", "lines", "pages")


@plan("c04_backup_history", """
SELECT 'db' || o_custkey AS database_name, o_orderdate AS backup_start_date,
       o_orderdate + INTERVAL 90 SECOND AS backup_finish_date, 90::BIGINT AS duration_seconds,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Full' WHEN '2-HIGH' THEN 'Differential' ELSE 'Transaction Log' END AS backup_type,
       CAST(round(o_totalprice * 100) AS BIGINT) / 1048576.0::DOUBLE AS backup_size_mb,
       CAST(floor(o_totalprice) AS BIGINT) / 1048576.0::DOUBLE AS compressed_size_mb, c_name AS physical_device_name
FROM orders JOIN customer ON o_custkey = c_custkey
ORDER BY o_orderdate DESC, o_custkey, round(o_totalprice * 100) LIMIT 10
""")
def backup_history(t):
    sets = t.orders.select(
        F.concat(F.lit("db"), F.col("o_custkey")).alias("database_name"), F.col("o_orderdate").alias("backup_start_date"),
        (F.col("o_orderdate") + F.expr("INTERVAL 90 SECOND")).alias("backup_finish_date"),
        bands.decode("o_orderpriority", {"1-URGENT": "D", "2-HIGH": "I"}, "L").alias("type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("backup_size"),
        F.floor("o_totalprice").cast("long").alias("compressed_backup_size"), F.col("o_custkey").alias("media_set_id"),
    )
    media = t.customer.select(F.col("c_custkey").alias("media_set_id"), F.col("c_name").alias("physical_device_name"))
    return op.backup_history(sets, media, n=10)


@plan("c05_database_size", """
SELECT c_custkey AS database_id, c_name AS name, sum(CAST(floor(o_totalprice) AS BIGINT))::DOUBLE * 8.0 / 1024.0 AS size_mb
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name
""")
def database_size(t):
    databases = t.customer.select(F.col("c_custkey").alias("database_id"), F.col("c_name").alias("name"))
    files = t.orders.select(F.col("o_custkey").alias("database_id"), F.floor("o_totalprice").cast("long").alias("size"))
    return op.database_size(databases, files)


@plan("c06_can_rebuild_online", """
SELECT o_orderkey AS object_id, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS can_rebuild_online
FROM orders
""")
def can_rebuild_online(t):
    indexes = t.orders.select(F.col("o_orderkey").alias("object_id"), F.lit(1).alias("index_id"))
    index_columns = t.lineitem.select(F.col("l_orderkey").alias("object_id"), F.lit(1).alias("index_id"),
                                      F.col("l_linenumber").alias("column_id"))
    columns = t.lineitem.select(F.col("l_orderkey").alias("object_id"), F.col("l_linenumber").alias("column_id"),
                                bands.decode("l_returnflag", {"R": 35}, 56).alias("system_type_id"))
    return op.can_rebuild_online(indexes, index_columns, columns).select("object_id", "can_rebuild_online")


def orders_with_gaps(t):
    """Orders without the low-priority ones, so that some lines lose their parent."""
    return t.orders.filter(F.col("o_orderpriority") != "5-LOW")


@plan("c07_fk_check", """
SELECT l_orderkey, count(*) AS rows FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW')
GROUP BY l_orderkey
""")
def fk_check(t):
    return integrity.fk_check(t.lineitem, orders_with_gaps(t), ["l_orderkey"], ["o_orderkey"])


@plan("c07_fk_violating_rows", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority <> '5-LOW')
""")
def fk_violating_rows(t):
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    return integrity.fk_violations(lines, orders_with_gaps(t), ["l_orderkey"], ["o_orderkey"])


FOREIGN_KEYS = [
    integrity.ForeignKey("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    integrity.ForeignKey("orders", ("o_custkey",), "customer", ("c_custkey",)),
    integrity.ForeignKey("nation", ("n_regionkey",), "region", ("r_regionkey",)),
]


@plan("c07_fk_check_all", """
WITH kept AS (SELECT * FROM orders WHERE o_orderpriority <> '5-LOW'),
     bad AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM kept) GROUP BY 1)
SELECT 'lineitem(l_orderkey)->orders(o_orderkey)' AS "constraint", CAST(sum(n) AS BIGINT) AS violating_rows, count(*) AS violating_keys,
       (SELECT string_agg('{"l_orderkey":' || k || '}', ';' ORDER BY k) FROM (SELECT k FROM bad ORDER BY k LIMIT 5)) AS sample_keys FROM bad
UNION ALL SELECT 'orders(o_custkey)->customer(c_custkey)', count(*), count(DISTINCT o_custkey), '' FROM kept WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'nation(n_regionkey)->region(r_regionkey)', count(*), count(DISTINCT n_regionkey), '' FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)
""")
def fk_check_all(t):
    tables = {"lineitem": t.lineitem, "orders": orders_with_gaps(t), "customer": t.customer,
              "nation": t.nation, "region": t.region}
    return integrity.fk_check_all(tables, FOREIGN_KEYS)


@plan("c08_replica_lag", """
SELECT e.user_id AS "set", e.event_id AS name,
       (epoch_us(p.primary_optime) - epoch_us(e.ts)) / 1e6::DOUBLE AS lag_seconds
FROM events e JOIN (SELECT user_id, max(ts) AS primary_optime FROM events WHERE event_type = 'purchase' GROUP BY user_id) p USING (user_id)
WHERE e.event_type <> 'purchase'
""")
def replica_lag(t):
    members = t.events.select(
        F.col("user_id").alias("set"), F.col("event_id").alias("name"),
        bands.decode("event_type", {"purchase": "PRIMARY"}, "SECONDARY").alias("stateStr"), F.col("ts").alias("optimeDate"))
    return op.replica_lag(members)


@plan("c09_index_usage", """
WITH u AS (SELECT l_partkey, count(*) AS ops, max(l_shipdate) AS since FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01' GROUP BY l_partkey)
SELECT p_brand AS collection, p_partkey::VARCHAR AS name, p_type AS key, since, l_partkey IS NOT NULL AS stats_available, ops AS accesses, false AS unused
FROM part LEFT JOIN u ON p_partkey = l_partkey
""")
def index_usage(t):
    indexes = t.part.select(F.col("p_brand").alias("collection"), F.col("p_partkey").cast("string").alias("name"), F.col("p_type").alias("key"))
    late = t.lineitem.filter(F.col("l_shipdate") >= "2001-10-01").groupBy(F.col("l_partkey").cast("string").alias("name")).agg(
        F.count("*").alias("ops"), F.max("l_shipdate").alias("since"))
    usage = late.join(t.part.select(F.col("p_partkey").cast("string").alias("name"), F.col("p_brand").alias("collection")), "name")
    return op.index_usage_join(indexes, usage)


@plan("c10_merge_object_facts", """
SELECT s_name AS name, docs_count, store_size_bytes, coalesce(status, 'open') AS status, mapping, coalesce(health, 'Unknown') AS health,
       printf('%.1f', floor(store_size_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB' AS store_size_human
FROM (SELECT l_suppkey, count(*) AS docs_count, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS store_size_bytes FROM lineitem GROUP BY 1)
JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN (SELECT s_suppkey, 'close' AS status FROM supplier WHERE s_acctbal < 1000) a USING (s_suppkey)
LEFT JOIN (SELECT s_suppkey, n_name AS mapping FROM supplier JOIN nation ON s_nationkey = n_nationkey) b USING (s_suppkey)
LEFT JOIN (SELECT s_suppkey, 'green' AS health FROM supplier WHERE s_acctbal > 5000) c USING (s_suppkey)
""")
def merge_object_facts(t):
    per_supplier = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.count("*").alias("docs_count"), F.sum(F.col("l_quantity").cast("long")).alias("store_size_bytes"))
    named = t.supplier.select("s_suppkey", F.col("s_name").alias("name"))
    stats = per_supplier.join(named, "s_suppkey").select("name", "docs_count", "store_size_bytes")
    settings = t.supplier.filter(F.col("s_acctbal") < 1000).select(F.col("s_name").alias("name"), F.lit("close").alias("status"))
    mappings = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_name").alias("name"), F.col("n_name").alias("mapping"))
    health = t.supplier.filter(F.col("s_acctbal") > 5000).select(F.col("s_name").alias("name"), F.lit("green").alias("health"))
    return op.merge_object_facts(stats, settings, mappings, health, {"status": "open", "health": "Unknown"})


@plan("c11_exists_check", """
SELECT name, name IN (SELECT n_name FROM nation) AS present
FROM (VALUES ('NATION_1'), ('NATION_24'), ('NATION_99')) v(name)
""")
def exists_check(t):
    return op.exists_check(t.nation, "n_name", ["NATION_1", "NATION_24", "NATION_99"])
