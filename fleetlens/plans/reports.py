"""Named reports on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as op
from .registry import plan
from .shapes import cents, money


def tables_from_lines(t):
    """Parts as tables: sizes and activity from their lines."""
    quantity = F.col("l_quantity").cast("long")
    return t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("tablename")).agg(
        F.sum(cents("l_extendedprice")).alias("total_bytes"), F.sum(quantity).alias("table_bytes"),
        F.count("*").alias("seq_scan"), F.sum(quantity).alias("seq_tup_read"),
        F.count_if(F.col("l_returnflag") == "A").alias("n_tup_ins"), F.count_if(F.col("l_returnflag") == "N").alias("n_tup_upd"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_tup_del"),
        F.sum(F.when(F.col("l_linestatus") == "F", quantity).otherwise(0)).alias("n_dead_tup"),
        F.sum(F.when(F.col("l_linestatus") == "O", quantity).otherwise(0)).alias("n_live_tup"),
        F.max("l_shipdate").alias("last_vacuum"),
    ).withColumn("schemaname", F.lit("public"))


@plan("j01_table_sizes", """
SELECT 'public' AS schemaname, l_partkey::VARCHAR AS tablename, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes
FROM lineitem GROUP BY l_partkey ORDER BY size_bytes DESC, tablename LIMIT 20
""")
def table_sizes(t):
    return op.table_sizes(tables_from_lines(t)).select("schemaname", "tablename", "size_bytes")


@plan("j01_table_sizes_per_server", """
SELECT server_id, 'public' AS schemaname, tablename, size_bytes FROM (
  SELECT l_suppkey AS server_id, l_partkey::VARCHAR AS tablename, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes
  FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY size_bytes DESC, tablename) <= 3
""")
def table_sizes_per_server(t):
    tables = t.lineitem.groupBy(F.col("l_suppkey").alias("server_id"), F.col("l_partkey").cast("string").alias("tablename")).agg(
        F.sum(cents("l_extendedprice")).alias("total_bytes"), F.count("*").alias("table_bytes"))
    return op.table_sizes(tables.withColumn("schemaname", F.lit("public")), n=3, by=["server_id"]).select(
        "server_id", "schemaname", "tablename", "size_bytes")


@plan("j02_database_sizes", """
SELECT c_mktsegment AS database_name, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes
FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'MACHINERY' GROUP BY c_mktsegment
""")
def database_sizes(t):
    spent = t.orders.groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("bytes"))
    sizes = spent.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").groupBy(
        F.col("c_mktsegment").alias("datname")).agg(F.sum("bytes").alias("size_bytes"))
    return op.database_sizes(sizes.withColumn("datistemplate", F.col("datname") == "MACHINERY")).drop("size")


@plan("j03_index_usage", """
SELECT 'public' AS schemaname, l_partkey::VARCHAR AS tablename, l_suppkey::VARCHAR AS indexname,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END) AS BIGINT) AS idx_tup_read,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS idx_tup_fetch,
  coalesce(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)::DOUBLE * 100 / nullif(sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE CAST(l_quantity AS BIGINT) END), 0)::DOUBLE, 0.0::DOUBLE) AS fetch_ratio_percent
FROM lineitem GROUP BY l_partkey, l_suppkey
""")
def index_usage(t):
    quantity = F.col("l_quantity").cast("long")
    indexes = t.lineitem.groupBy(F.col("l_partkey").cast("string").alias("tablename"), F.col("l_suppkey").cast("string").alias("indexname")).agg(
        F.sum(F.when(F.col("l_returnflag") == "N", 0).otherwise(quantity)).alias("idx_tup_read"),
        F.sum(F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)).alias("idx_tup_fetch"),
    ).withColumn("schemaname", F.lit("public"))
    return op.index_usage(indexes, ordered=False)


@plan("j04_unused_indexes", """
SELECT p_brand AS schemaname, p_type AS tablename, p_partkey::VARCHAR AS indexname, CAST(round(p_retailprice * 100) AS BIGINT) * 20 AS index_bytes, 0::BIGINT AS idx_scan
FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-01') AND CAST(round(p_retailprice * 100) AS BIGINT) * 20 > 1048576
""")
def unused_indexes(t):
    late = t.lineitem.filter(F.col("l_shipdate") >= "2001-10-01").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.count("*").alias("idx_scan"))
    indexes = t.part.join(late, "p_partkey", "left").select(
        F.col("p_brand").alias("schemaname"), F.col("p_type").alias("tablename"), F.col("p_partkey").cast("string").alias("indexname"),
        (cents("p_retailprice") * 20).alias("index_bytes"), F.coalesce("idx_scan", F.lit(0)).alias("idx_scan"),
        F.lit(0).alias("idx_tup_read"), F.lit(0).alias("idx_tup_fetch"))
    return op.unused_indexes(indexes, ordered=False).select("schemaname", "tablename", "indexname", "index_bytes", "idx_scan")


@plan("j05_missing_index_candidates", """
SELECT 'public' AS schemaname, l_partkey::VARCHAR AS tablename, count(*) AS seq_scan, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS seq_tup_read,
  count(*) AS total_writes, sum(CAST(l_quantity AS BIGINT))::DOUBLE / count(*)::DOUBLE AS avg_seq_read_per_scan
FROM lineitem GROUP BY l_partkey HAVING count(*) > 30 AND sum(CAST(l_quantity AS BIGINT)) > 800
""")
def missing_index_candidates(t):
    return op.missing_index_candidates(tables_from_lines(t), scans=30, rows=800, ordered=False)


STATEMENT_SQL = """
SELECT doc_id, left(text, 100) AS query_snippet, n_chars AS calls, n_chars * 2.0::DOUBLE AS total_time, 2.0::DOUBLE AS mean_time, doc_id AS rows,
  (n_chars % 10)::DOUBLE * 100 / nullif(n_chars % 10 + doc_id % 5, 0)::DOUBLE AS hit_percent FROM documents
"""


def statements(t):
    return t.documents.select(
        "doc_id", F.col("text").alias("query"), F.col("n_chars").alias("calls"), (F.col("n_chars") * 2.0).alias("total_time"),
        F.lit(2.0).alias("mean_time"), F.col("doc_id").alias("rows"), (F.col("n_chars") % 10).alias("shared_blks_hit"),
        (F.col("doc_id") % 5).alias("shared_blks_read"))


@plan("j06_top_queries_by_time", STATEMENT_SQL + " ORDER BY total_time DESC, doc_id LIMIT 10")
def top_queries_by_time(t):
    return op.top_queries(statements(t), "total_time", tie=["doc_id"])


@plan("j06_top_queries_by_calls", STATEMENT_SQL + " ORDER BY calls DESC, doc_id LIMIT 10")
def top_queries_by_calls(t):
    return op.top_queries(statements(t), "calls", tie=["doc_id"])


@plan("j06_top_queries_per_server", f"""
SELECT s.* , source AS server_id FROM ({STATEMENT_SQL}) s JOIN (SELECT doc_id, source FROM documents) USING (doc_id)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY total_time DESC, doc_id) <= 10
""")
def top_queries_per_server(t):
    servers = statements(t).join(t.documents.select("doc_id", F.col("source").alias("server_id")), "doc_id")
    return op.top_queries(servers, "total_time", tie=["doc_id"], per=["server_id"])


@plan("j07_vacuum_candidates", """
SELECT 'public' AS schemaname, l_partkey::VARCHAR AS tablename, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'F'), 0) AS BIGINT) AS n_dead_tup,
  CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_linestatus = 'O'), 0) AS BIGINT) AS n_live_tup,
  n_dead_tup::DOUBLE * 100 / nullif(n_live_tup, 0)::DOUBLE AS dead_tuple_percent, max(l_shipdate) AS last_vacuum
FROM lineitem GROUP BY l_partkey HAVING n_dead_tup > 400
""")
def vacuum_candidates(t):
    tables = tables_from_lines(t).withColumn("last_autovacuum", F.lit(None).cast("timestamp"))
    return op.vacuum_candidates(tables, dead=400, ordered=False).drop("last_autovacuum")


@plan("j08_analyze_candidates", """
SELECT 'public' AS schemaname, l_partkey::VARCHAR AS tablename, count(*) AS n_mod_since_analyze, max(l_shipdate) AS last_analyze
FROM lineitem GROUP BY l_partkey HAVING count(*) > 30
""")
def analyze_candidates(t):
    tables = tables_from_lines(t).withColumns({
        "n_mod_since_analyze": F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del"),
        "last_analyze": F.col("last_vacuum"), "last_autoanalyze": F.lit(None).cast("timestamp")})
    return op.analyze_candidates(tables, modified=30, ordered=False).drop("last_autoanalyze")


PROFILE_SQL = """
SELECT event_id, ts, CAST(floor(value) AS BIGINT) AS millis, event_type AS op, 'ns' || user_id AS ns, left(props, 100) || '...' AS command,
  coalesce(CASE WHEN user_id % 2 = 0 THEN user_id END, 0) AS docs_examined, 1::BIGINT AS docs_returned FROM events
"""


def profile(t):
    return t.events.select(
        "event_id", "ts", F.floor("value").cast("long").alias("millis"), F.col("event_type").alias("op"),
        F.concat(F.lit("ns"), "user_id").alias("ns"), F.col("props").alias("command"),
        F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("docsExamined"), F.lit(1).cast("long").alias("nreturned"))


@plan("j09_slow_ops_recent", PROFILE_SQL + " ORDER BY ts DESC, event_id DESC LIMIT 10")
def slow_ops_recent(t):
    return op.slow_ops(profile(t), tie=["event_id"])


@plan("j09_slow_ops_slowest", PROFILE_SQL + " ORDER BY millis DESC, event_id DESC LIMIT 10")
def slow_ops_slowest(t):
    return op.slow_ops(profile(t), "slowest", tie=["event_id"])


@plan("j09_slow_ops_per_server", f"""
SELECT p.*, user_id AS server_id FROM ({PROFILE_SQL}) p JOIN (SELECT event_id, user_id FROM events) USING (event_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY millis DESC, event_id DESC) <= 2
""")
def slow_ops_per_server(t):
    servers = profile(t).join(t.events.select("event_id", F.col("user_id").alias("server_id")), "event_id")
    return op.slow_ops(servers, "slowest", n=2, tie=["event_id"], by=["server_id"])


@plan("j09_slow_log", """
SELECT event_id AS id, date_trunc('second', ts) AS timestamp, CAST(floor(value) AS BIGINT) AS duration_microseconds,
  CAST(floor(value) AS BIGINT) / 1000.0::DOUBLE AS duration_milliseconds, event_type || ' ' || user_id AS command, 'Unknown' AS client_address, 'Unknown' AS client_name
FROM events ORDER BY event_id DESC LIMIT 10
""")
def slow_log(t):
    entries = t.events.select(
        F.col("event_id").alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("start_time"),
        F.floor("value").cast("long").alias("duration"), F.array("event_type", F.col("user_id").cast("string")).alias("command"),
        F.lit(None).cast("string").alias("client_address"), F.lit(None).cast("string").alias("client_name"))
    return op.slow_log(entries).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@plan("j10_collection_stats", """
SELECT source AS name, count(*) AS count, sum(n_chars) / 1048576.0::DOUBLE AS size_mb, sum(doc_id) / 1048576.0::DOUBLE AS storage_mb,
  sum(n_chars)::DOUBLE / count(*)::DOUBLE AS avg_doc_size, 0.0::DOUBLE AS index_mb
FROM documents GROUP BY source ORDER BY sum(n_chars) DESC, source LIMIT 10
""")
def collection_stats(t):
    collections = t.documents.groupBy(F.col("source").alias("name")).agg(
        F.count("*").alias("count"), F.sum("n_chars").alias("size"), F.sum("doc_id").alias("storageSize"),
        F.lit(None).cast("long").alias("totalIndexSize"))
    return op.collection_stats(collections)


@plan("j10_collection_stats_per_server", """
SELECT server_id, name, count, size / 1048576.0::DOUBLE AS size_mb FROM (
  SELECT lang AS server_id, source AS name, count(*) AS count, sum(n_chars) AS size FROM documents GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY size DESC, name) <= 2
""")
def collection_stats_per_server(t):
    collections = t.documents.groupBy(F.col("lang").alias("server_id"), F.col("source").alias("name")).agg(
        F.count("*").alias("count"), F.sum("n_chars").alias("size"), F.sum("doc_id").alias("storageSize"),
        F.lit(None).cast("long").alias("totalIndexSize"))
    return op.collection_stats(collections, n=2, by=["server_id"]).select("server_id", "name", "count", "size_mb")


@plan("j10_store_statistics", """
SELECT lang AS name, sum(n_chars) / 1048576.0::DOUBLE AS size_mb, sum(n_chars) / 1048576.0::DOUBLE AS storage_mb, count(DISTINCT source) AS collections, 0::BIGINT AS indexes, count(*) AS objects
FROM documents GROUP BY lang
""")
def store_statistics(t):
    per_source = t.documents.groupBy("lang", "source").agg(F.sum("n_chars").alias("size"), F.count("*").alias("n"))
    stores = per_source.groupBy(F.col("lang").alias("name")).agg(
        F.sum("size").alias("dataSize"), F.sum("size").alias("storageSize"), F.count("*").alias("collections"),
        F.lit(0).cast("long").alias("indexes"), F.sum("n").alias("objects"))
    return op.store_statistics(stores)


@plan("j10_store_cache_ratios", """
SELECT s_suppkey AS server_id, s_nationkey AS pages_read_in, s_suppkey AS pages_requested,
  (s_suppkey - s_nationkey)::DOUBLE * 100 / nullif(s_suppkey, 0)::DOUBLE AS hit_ratio, s_nationkey::DOUBLE * 100 / nullif(s_nationkey + s_suppkey, 0)::DOUBLE AS ref_ratio
FROM supplier
""")
def store_cache_ratios(t):
    return op.store_cache_ratios(t.supplier.select(
        F.col("s_suppkey").alias("server_id"), F.col("s_nationkey").alias("pages_read_in"), F.col("s_suppkey").alias("pages_requested")))


@plan("j11_counters_long", """
SELECT event_id, 'k' AS counter, CAST(json_extract(props, '$.k') AS BIGINT) AS value FROM events
""")
def counters_long(t):
    maps = t.events.select("event_id", F.from_json("props", "map<string,bigint>").alias("opcounters"))
    return op.counters_long(maps, "opcounters", ["event_id"])


@plan("j11_lock_counters_long", """
SELECT event_id, event_type AS lock_type, 'k' AS mode, CAST(json_extract(props, '$.k') AS BIGINT) AS acquired FROM events
""")
def lock_counters_long(t):
    maps = t.events.select("event_id", F.create_map("event_type", F.from_json("props", "map<string,bigint>")).alias("locks"))
    return op.lock_counters_long(maps, "locks", ["event_id"])


def hosts(t):
    peers = t.supplier.select(
        F.when(F.col("s_suppkey") % 9 != 0, F.col("s_name")).alias("peer"), F.concat(F.lit("dc"), "s_nationkey").alias("data_center"),
        F.lit("r1").alias("rack"), F.lit("4.1").alias("version"),
        F.when(F.col("s_suppkey") % 2 == 0, F.split("s_name", "0")).alias("tokens"))
    local = t.region.select(F.concat(F.lit("dc"), "r_regionkey").alias("data_center"), F.lit("r1").alias("rack"),
                            F.lit("4.1").alias("version"), F.array("r_name").alias("tokens"))
    return op.topology_hosts(peers, local)


@plan("j12_topology_hosts", """
SELECT CASE WHEN s_suppkey % 9 <> 0 THEN s_name ELSE 'Unknown' END AS peer, 'dc' || s_nationkey AS data_center, 'r1' AS rack, '4.1' AS version,
  CASE WHEN s_suppkey % 2 = 0 THEN len(string_split(s_name, '0'))::INTEGER ELSE 0 END AS tokens FROM supplier
UNION ALL SELECT 'local', 'dc' || r_regionkey, 'r1', '4.1', 1 FROM region
""")
def topology_hosts(t):
    return hosts(t)


@plan("j12_hosts_per_data_center", """
SELECT data_center, count(*) AS hosts FROM (SELECT 'dc' || s_nationkey AS data_center FROM supplier UNION ALL SELECT 'dc' || r_regionkey FROM region) GROUP BY data_center
""")
def hosts_per_data_center(t):
    return op.hosts_per_data_center(hosts(t))


@plan("j12_user_keyspaces", """
SELECT c_name AS name FROM customer WHERE c_mktsegment <> 'MACHINERY'
""")
def user_keyspaces(t):
    spaces = t.customer.select(F.when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("system_"), "c_name"))
                               .otherwise(F.col("c_name")).alias("name"))
    return op.user_keyspaces(spaces)


@plan("j13_cluster_nodes", """
SELECT s_suppkey AS cluster, 'n' || s_suppkey AS id, s_name AS host, 6379 AS port, 'Unknown' AS master, true AS is_master, 2 AS slot_ranges FROM supplier
UNION ALL SELECT s_suppkey, 'Unknown', s_name, CAST(s_nationkey AS INTEGER), 'n' || s_suppkey, false, 0 FROM supplier
""")
def cluster_nodes(t):
    nothing = F.lit(None).cast("string")
    node = "struct<id:string,host:string,port:int,flags:array<string>,master:string,slots:array<string>>"
    first = F.struct(F.concat(F.lit("n"), "s_suppkey"), F.col("s_name"), F.lit(6379), F.array(F.lit("master")),
                     nothing, F.array(F.lit("0-99"), F.lit("200-299"))).cast(node)
    second = F.struct(nothing, F.col("s_name"), F.col("s_nationkey"), F.array(F.lit("slave")),
                      F.concat(F.lit("n"), "s_suppkey"), F.lit(None).cast("array<string>")).cast(node)
    return op.cluster_nodes(t.supplier.select(F.col("s_suppkey").alias("cluster"), F.array(first, second).alias("nodes")), ["cluster"])


@plan("j14_server_report", """
WITH o AS (SELECT o_custkey, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS amount FROM orders GROUP BY o_custkey),
     r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
SELECT c_custkey AS server_id, c_mktsegment AS segment, orders, amount,
  coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) FROM r WHERE r.o_custkey = c_custkey AND n <= 3), '') AS latest
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey
""")
def server_report(t):
    orders = t.orders.select(F.col("o_custkey").alias("server_id"), "o_orderkey", "o_orderdate", money("o_totalprice").alias("price"))
    report = op.server_report(
        {"info": t.customer.select(F.col("c_custkey").alias("server_id"), F.col("c_mktsegment").alias("segment")),
         "totals": orders.groupBy("server_id").agg(F.count("*").alias("orders"), F.sum("price").cast("double").alias("amount"))},
        ["server_id"],
        {"latest": (orders.select("server_id", "o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)})
    keys = F.transform("latest", lambda row: row["o_orderkey"].cast("string"))
    return report.select("server_id", "info.segment", "totals.orders", "totals.amount",
                         F.coalesce(F.array_join(keys, ","), F.lit("")).alias("latest"))


@plan("j15_keyspace_info", """
SELECT event_id, 'db0' AS database, user_id AS keys, 0::BIGINT AS expires, CAST(floor(value) AS BIGINT) AS avg_ttl FROM events
UNION ALL SELECT event_id, 'db1', event_id, user_id, NULL FROM events
""")
def keyspace_info(t):
    packed = F.create_map(
        F.lit("db0"), F.concat(F.lit("keys="), "user_id", F.lit(",expires=0,avg_ttl="), F.floor("value").cast("string")),
        F.lit("db1"), F.concat(F.lit("keys="), "event_id", F.lit(",expires="), "user_id"),
        F.lit("other"), F.lit("keys=1"))
    return op.keyspace_info(t.events.select("event_id", packed.alias("keyspace")), ["event_id"])
