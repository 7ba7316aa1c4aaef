"""Aggregations on the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import bands
from ..operators import aggregates as op
from ..operators import integrity
from ..workspace import new_dir
from .registry import EVENTS_AS_OF, plan
from .shapes import TRIAGE_SQL, cents, money, triage


@plan("d01_count_by", "SELECT event_type, count(*) AS count FROM events GROUP BY event_type")
def count_by(t):
    return op.count_by(t.events, "event_type")


@plan("d02_operation_summary", f"""
WITH {TRIAGE_SQL}
SELECT operation, count(*) AS index_count, CAST(sum(page_count) AS BIGINT) AS total_pages,
       CAST(sum(CAST(fragmentation_percent AS DECIMAL(18,9))) AS DOUBLE) / count(*)::DOUBLE AS avg_fragmentation,
       min(CAST(fragmentation_percent AS DECIMAL(18,9)))::DOUBLE AS min_fragmentation,
       max(CAST(fragmentation_percent AS DECIMAL(18,9)))::DOUBLE AS max_fragmentation
FROM triage WHERE operation <> 'NONE' GROUP BY operation
""")
def operation_summary(t):
    # Nine decimals make the mean independent of the order of the sum.
    exact = triage(t).withColumn("fragmentation_percent", F.col("fragmentation_percent").cast("decimal(18,9)"))
    return op.operation_summary(exact).withColumns({
        f"{f}_fragmentation": F.col(f"{f}_fragmentation").cast("double") for f in ("min", "max")})


def block_stats(t):
    quantity = F.col("l_quantity").cast("long")
    return t.lineitem.select(
        F.col("l_suppkey").alias("datname"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(quantity).alias("blks_hit"),
        F.when(F.col("l_returnflag") == "N", quantity).otherwise(0).alias("blks_read"))


HIT_SQL = """
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'N'), 0) AS BIGINT) AS blks_hit,
CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS blks_read,
coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag <> 'N'), 0)::DOUBLE * 100 / sum(CAST(l_quantity AS BIGINT))::DOUBLE AS cache_hit_ratio
"""


@plan("d03_cache_hit_ratio", f"SELECT {HIT_SQL} FROM lineitem")
def cache_hit_ratio(t):
    return op.cache_hit_ratio(block_stats(t))


@plan("d03_cache_hit_ratio_by_database",
      f"SELECT l_suppkey AS datname, {HIT_SQL} FROM lineitem GROUP BY l_suppkey HAVING blks_read > 0")
def cache_hit_ratio_by_database(t):
    return op.cache_hit_ratio(block_stats(t), by=["datname"], only_with_reads=True)


def replicas_from_orders(t):
    """Orders as replica rows of their customer's server."""
    yes = bands.decode("o_orderstatus", {"O": "Yes", "P": "No"})
    return t.orders.select(
        F.col("o_custkey").alias("server_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("extra")).otherwise(F.lit("")).alias("channel_name"),
        yes.alias("slave_io_running"), yes.alias("slave_sql_running"),
        F.when(F.col("o_orderstatus") != "F", F.floor("o_totalprice").cast("long")).alias("seconds_behind_master"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2003).otherwise(0).alias("last_io_errno"),
        F.lit(0).alias("last_sql_errno"),
    )


@plan("d04_replication_summary", """
WITH c AS (SELECT o_custkey AS server_id, count(*) FILTER (o_orderpriority <> '5-LOW') AS n,
  count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'O') AS running,
  count(*) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus = 'P') AS stopped,
  CAST(max(floor(o_totalprice)) FILTER (o_orderpriority <> '5-LOW' AND o_orderstatus <> 'F') AS BIGINT) AS lag,
  count(*) FILTER (o_orderpriority = '1-URGENT') AS errors FROM orders GROUP BY o_custkey)
SELECT server_id, 'Overall_Replication_Health' AS check_name,
  CASE WHEN running > 0 THEN 'HEALTHY' WHEN stopped > 0 THEN 'UNHEALTHY' ELSE 'NOT_A_SLAVE' END AS status,
  CASE WHEN n = 0 THEN 'This server is not configured as a replication slave' ELSE 'Check individual metrics above for details' END AS details FROM c
UNION ALL SELECT server_id, 'Replication_Lag_Status',
  CASE WHEN lag IS NULL THEN 'REPLICATION_STOPPED' WHEN lag = 0 THEN 'SYNCHRONIZED' WHEN lag < 60 THEN 'ACCEPTABLE_LAG' ELSE 'HIGH_LAG' END,
  coalesce(lag, -1) || ' seconds behind master' FROM c
UNION ALL SELECT server_id, 'Replication_Errors',
  CASE WHEN errors > 0 THEN 'ERRORS_PRESENT' WHEN n = 0 THEN 'NOT_APPLICABLE' ELSE 'NO_ERRORS' END,
  CASE WHEN n = 0 THEN 'Not a slave server' ELSE 'Check error details above' END FROM c
""")
def replication_summary(t):
    return op.replication_summary(replicas_from_orders(t), by=["server_id"])


@plan("d05_backup_success_rate", """
SELECT o_orderpriority AS database, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful,
       count(*) FILTER (o_orderstatus <> 'F') AS failed,
       count(*) FILTER (o_orderstatus = 'F')::DOUBLE * 100 / count(*)::DOUBLE AS success_rate
FROM orders GROUP BY o_orderpriority
""")
def backup_success_rate(t):
    return op.backup_success_rate(reports(t), by=["database"])


def reports(t):
    return t.orders.select(F.col("o_orderpriority").alias("database"),
                           bands.decode("o_orderstatus", {"F": "Success"}, "Failed").alias("status"))


@plan("d05_backup_success_rate_whole", """
SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus <> 'F') AS failed,
       count(*) FILTER (o_orderstatus = 'F') * 100 // count(*) AS success_rate FROM orders
""")
def backup_success_rate_whole(t):
    return op.backup_success_rate(reports(t), int_pct=True)


@plan("d06_size_rollup", """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_bytes,
       count(*) AS objects, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)
""")
def size_rollup(t):
    sized = t.lineitem.select("l_returnflag", "l_linestatus", cents("l_extendedprice").alias("bytes"))
    return op.size_rollup(sized, ["l_returnflag", "l_linestatus"])


@plan("d07_database_inventory", """
SELECT n_name AS database, count(*) AS tables, CAST(sum(c_custkey) AS BIGINT) AS rows,
       CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS bytes
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def database_inventory(t):
    tables = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("database"), F.col("c_custkey").alias("total_rows"), cents("c_acctbal").alias("total_bytes"))
    return op.database_inventory(tables)


@plan("d07_ranked_tables", """
SELECT n_name AS database, c_name AS name, c_custkey AS total_rows, CAST(round(c_acctbal * 100) AS BIGINT) AS total_bytes
FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY total_bytes DESC, database, name LIMIT 20
""")
def ranked_tables(t):
    tables = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("database"), F.col("c_name").alias("name"), F.col("c_custkey").alias("total_rows"),
        cents("c_acctbal").alias("total_bytes"))
    return op.ranked_tables(tables).drop("size_human")


@plan("d07_ranked_tables_per_server", """
SELECT server_id, database, name, total_rows, total_bytes FROM (
  SELECT n_regionkey AS server_id, n_name AS database, c_name AS name, c_custkey AS total_rows, CAST(round(c_acctbal * 100) AS BIGINT) AS total_bytes
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
QUALIFY row_number() OVER (PARTITION BY server_id ORDER BY total_bytes DESC, server_id, database, name) <= 20
""")
def ranked_tables_per_server(t):
    tables = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("server_id"), F.col("n_name").alias("database"), F.col("c_name").alias("name"),
        F.col("c_custkey").alias("total_rows"), cents("c_acctbal").alias("total_bytes"))
    return op.ranked_tables(tables, by=["server_id", "database"], per=["server_id"]).drop("size_human")


def keys_from_documents(t):
    return t.documents.select(F.concat("source", F.lit("_"), "lang", F.lit(":"), F.col("doc_id")).alias("key"),
                              F.col("lang").alias("type"), F.col("n_chars").alias("bytes"))


PATTERN_SQL = """
SELECT source AS pattern, count(*) AS count, CAST(sum(n_chars) AS BIGINT) AS total_size, max(n_chars) AS max_size,
       sum(n_chars)::DOUBLE / count(*)::DOUBLE AS avg_size FROM documents GROUP BY source
"""


@plan("d08_key_patterns", PATTERN_SQL)
def key_patterns(t):
    return op.key_patterns(keys_from_documents(t))


@plan("d08_many_key_patterns", """
SELECT 'h' || o_custkey AS pattern, count(*) AS count, CAST(sum(o_orderkey) AS BIGINT) AS total_size, max(o_orderkey) AS max_size,
       sum(o_orderkey)::DOUBLE / count(*)::DOUBLE AS avg_size FROM orders GROUP BY o_custkey
""")
def many_key_patterns(t):
    return op.key_patterns(t.orders.select(
        F.concat(F.lit("h"), "o_custkey", F.lit(":"), "o_orderkey").alias("key"), F.col("o_orderstatus").alias("type"),
        F.col("o_orderkey").alias("bytes")))


@plan("d08_top_patterns", f"""
WITH p AS ({PATTERN_SQL} ORDER BY count(*) DESC, source LIMIT 10),
     s AS (SELECT source AS pattern, source || '_' || lang || ':' || doc_id AS k,
                  row_number() OVER (PARTITION BY source ORDER BY source || '_' || lang || ':' || doc_id) AS n FROM documents),
     y AS (SELECT source AS pattern, lang, count(*) AS n FROM documents GROUP BY ALL)
SELECT p.*, (SELECT string_agg(k, ' ' ORDER BY k) FROM s WHERE s.pattern = p.pattern AND n <= 5) AS sample_keys,
  (SELECT string_agg(lang || '=' || n, ' ' ORDER BY lang) FROM y WHERE y.pattern = p.pattern) AS types FROM p
""")
def top_patterns(t):
    entries = F.transform(F.array_sort(F.map_entries("types")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return op.top_patterns(keys_from_documents(t)).withColumns(
        {"sample_keys": F.array_join("sample_keys", " "), "types": F.array_join(entries, " ")})


@plan("d08_key_pattern_types", """
SELECT source AS pattern, lang AS type, count(*) AS n FROM documents GROUP BY ALL
""")
def key_pattern_types(t):
    return op.key_pattern_types(keys_from_documents(t)).select("pattern", "type", "n")


@plan("d08_frequent_patterns", """
WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)
SELECT word AS pattern, count(*) AS count, CAST(sum(doc_id) AS BIGINT) AS total_size, max(doc_id) AS max_size, sum(doc_id)::DOUBLE / count(*)::DOUBLE AS avg_size, true AS certain
FROM w WHERE regexp_full_match(word, '[a-z]+') GROUP BY word ORDER BY count(*) DESC, word LIMIT 10
""")
def frequent_patterns(t):
    """Words of all documents as key prefixes: the ten most frequent of a vocabulary that grows with the documents."""
    words = t.documents.select("doc_id", F.explode(F.split("text", " ")).alias("word")).filter(F.col("word").rlike("^[a-z]+$"))
    keys = words.select(F.concat("word", F.lit(":"), "doc_id").alias("key"), F.col("doc_id").alias("bytes"))
    return op.frequent_patterns(keys).drop("error_bound")


@plan("d08_key_totals", """
SELECT count(*) AS total_keys_analyzed, CAST(sum(n_chars) AS BIGINT) AS total_memory_analyzed FROM documents
""")
def key_totals(t):
    return op.key_totals(keys_from_documents(t))


@plan("d08_key_sample", """
SELECT source || '_' || lang || ':' || doc_id AS key, lang AS type, n_chars AS bytes FROM documents
WHERE ('0x' || left(md5(source || '_' || lang || ':' || doc_id), 8))::BIGINT % 4 = 0
""")
def key_sample(t):
    return op.key_sample(keys_from_documents(t), "key", 4)


@plan("d09_shard_distribution", """
WITH c AS (SELECT l_suppkey AS ns, l_returnflag AS shard, count(*) AS chunks FROM lineitem GROUP BY ALL),
     s AS (SELECT ns, count(*) AS shards, max(chunks)::DOUBLE / min(chunks)::DOUBLE AS skew FROM c GROUP BY ns HAVING count(*) > 1)
SELECT c.ns, shard, chunks, shards, skew FROM c JOIN s ON c.ns = s.ns
""")
def shard_distribution(t):
    return op.shard_distribution(t.lineitem.select(F.col("l_suppkey").alias("ns"), F.col("l_returnflag").alias("shard")))


@plan("d10_series_cardinality", "SELECT count(*) AS series FROM (SELECT DISTINCT user_id, event_type FROM events)")
def series_cardinality(t):
    return op.series_cardinality(t.events, ["user_id", "event_type"])


@plan("d10_series_cardinality_approx", """
SELECT event_type, count(DISTINCT user_id) AS series, true AS close FROM events GROUP BY event_type
""")
def series_cardinality_approx(t):
    exact = op.series_cardinality(t.events, ["user_id"], by=["event_type"])
    guess = op.series_cardinality(t.events, ["user_id"], by=["event_type"], approx=True)
    both = exact.join(guess.withColumnRenamed("series", "guess"), "event_type")
    return both.select("event_type", "series", (F.abs(F.col("guess") - F.col("series")) <= F.col("series") * 0.2).alias("close"))


@plan("d10_cardinality_states", """
SELECT 'day' AS unit, date_trunc('day', ts)::TIMESTAMP AS span, event_type, count(DISTINCT user_id) AS series, true AS close FROM events GROUP BY ALL
UNION ALL SELECT 'week', date_trunc('week', ts)::TIMESTAMP, event_type, count(DISTINCT user_id), true FROM events GROUP BY ALL
UNION ALL SELECT 'year', date_trunc('year', ts)::TIMESTAMP, event_type, count(DISTINCT user_id), true FROM events GROUP BY ALL
""")
def cardinality_states(t):
    """Stored hourly states, rolled up to days, weeks and years, against exact counts: within three standard errors."""
    path = new_dir(t.spark, "states")
    op.cardinality_states(t.events, ["user_id"], by=["event_type"]).write.parquet(path)
    states = t.spark.read.parquet(path)
    spans = []
    for unit in ("day", "week", "year"):
        span = F.date_trunc(unit, F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("span")
        exact = t.events.groupBy("event_type", span).agg(F.count_distinct("user_id").alias("series"))
        guess = op.cardinality_rollup(states, ["event_type"], unit).withColumnRenamed("series", "guess")
        spans.append(exact.join(guess, ["event_type", "span"], "full").withColumn("unit", F.lit(unit)))
    off = F.abs(F.col("guess") - F.col("series"))
    return reduce(DataFrame.unionByName, spans).select(
        "unit", "span", "event_type", "series", (off <= F.greatest(F.lit(1.0), 3 * 1.04 / 64 * F.col("series"))).alias("close"))


@plan("d10_measurements", "SELECT DISTINCT event_type FROM events")
def measurements(t):
    return op.measurements(t.events, "event_type")


def metric_points(t):
    return t.events.select(F.col("event_type").alias("metric"), "ts", money("value").alias("value"))


HOURLY_SQL = """
h AS (SELECT event_type AS metric, date_trunc('hour', ts) AS hour, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
      FROM events WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL)
"""


@plan("d11_hourly_metrics", f"""
WITH {HOURLY_SQL}
SELECT metric, round_even(sum(average) / count(*)::DOUBLE, 6) AS average, round_even(max(average), 6) AS maximum FROM h GROUP BY metric
""")
def hourly_metrics(t):
    return op.hourly_metrics(metric_points(t), EVENTS_AS_OF, digits=6)


@plan("d11_hourly_points", """
SELECT event_type AS metric, date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end,
       CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) / count(*)::DOUBLE AS average
FROM events GROUP BY ALL
""")
def hourly_points(t):
    return op.hourly_points(metric_points(t), ["metric"]).withColumns({
        c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def snapshot_tables(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("snapshot"), F.col("l_returnflag").alias("keyspace"), F.col("l_linestatus").alias("table"),
        cents("l_extendedprice").alias("size_bytes"), F.col("l_quantity").cast("long").alias("true_size_bytes"))


@plan("d12_snapshot_totals", """
SELECT l_orderkey AS snapshot, count(DISTINCT l_returnflag || l_linestatus) AS tables,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS total_size,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total_true_size
FROM lineitem GROUP BY l_orderkey
""")
def snapshot_totals(t):
    return op.snapshot_totals(snapshot_tables(t))


@plan("d12_snapshot_contents", """
SELECT l_orderkey AS snapshot, l_returnflag AS keyspace, l_linestatus AS "table",
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS size_bytes,
       CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS true_size_bytes
FROM lineitem GROUP BY ALL
""")
def snapshot_contents(t):
    return op.snapshot_contents(snapshot_tables(t))


@plan("d13_latest_metric", """
SELECT user_id, event_type, max(ts) AS ts, arg_max(value, ts) AS value FROM events GROUP BY ALL
""")
def latest_metric(t):
    return op.latest_metric(t.events, ["user_id", "event_type"])


def instances(t):
    return t.customer.select(F.col("c_name").alias("identifier"),
                             F.when(F.col("c_acctbal") < 500, 0).otherwise(7).alias("backup_retention_period"))


def clusters(t):
    return t.supplier.select(F.col("s_name").alias("identifier"),
                             F.when(F.col("s_acctbal") < 500, 0).otherwise(7).alias("backup_retention_period"))


@plan("d14_backup_config_issues", """
SELECT 'Instance' AS kind, c_name AS identifier, 'Instance ' || c_name || ' has automated backups disabled' AS issue FROM customer WHERE c_acctbal < 500
UNION ALL SELECT 'Cluster', s_name, 'Cluster ' || s_name || ' has automated backups disabled' FROM supplier WHERE s_acctbal < 500
""")
def backup_config_issues(t):
    return op.backup_config_issues(instances(t), clusters(t))


@plan("d14_backup_config_counts", """
SELECT 'Instance' AS kind, count(*) AS total, count(*) FILTER (c_acctbal < 500) AS issues FROM customer
UNION ALL SELECT 'Cluster', count(*), count(*) FILTER (s_acctbal < 500) FROM supplier
""")
def backup_config_counts(t):
    return op.backup_config_counts(instances(t), clusters(t))


@plan("d15_rollup_status", """
SELECT c_nationkey AS server_id, count(*) AS findings, 0::BIGINT AS info, count(*) FILTER (c_acctbal >= 100) AS warning,
       count(*) FILTER (c_acctbal < 100) AS critical, 0::BIGINT AS error, 'ISSUES_FOUND' AS status
FROM customer WHERE c_acctbal < 1000 GROUP BY c_nationkey
""")
def rollup_status(t):
    findings = t.customer.filter(F.col("c_acctbal") < 1000).select(
        F.col("c_nationkey").alias("server_id"),
        F.when(F.col("c_acctbal") < 100, "CRITICAL").otherwise("WARNING").alias("severity"))
    return op.rollup_status(findings, by=["server_id"])


@plan("d16_profile_table", """
SELECT * FROM (
SELECT 'customer' AS "table", 0 AS position, 'c_custkey' AS "column", 'bigint' AS type, true AS primary_key, count(*) AS row_count, count(*) - count(c_custkey) AS null_count FROM customer
UNION ALL SELECT 'customer', 1, 'c_name', 'string', false, count(*), count(*) - count(c_name) FROM customer
UNION ALL SELECT 'customer', 2, 'c_nationkey', 'int', false, count(*), count(*) - count(c_nationkey) FROM customer
UNION ALL SELECT 'customer', 3, 'c_acctbal', 'double', false, count(*), count(*) - count(CASE WHEN c_acctbal < 9000 THEN 1 END) FROM customer
UNION ALL SELECT 'customer', 4, 'c_mktsegment', 'string', false, count(*), count(*) - count(nullif(c_mktsegment, 'MACHINERY')) FROM customer)
""")
def profile_table(t):
    holey = t.customer.withColumns({
        "c_acctbal": F.when(F.col("c_acctbal") < 9000, F.col("c_acctbal")),
        "c_mktsegment": F.nullif("c_mktsegment", F.lit("MACHINERY"))})
    return integrity.profile_table(holey, "customer", primary_key=["c_custkey"]).drop(
        "approx_distinct", "not_null", "default")


PROFILED = ["customer", "orders", "lineitem", "events", "documents"]


@plan("d16_profile_database", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", column_name AS "column", (SELECT count(*) FROM {name}) AS row_count, 0::BIGINT AS null_count FROM (DESCRIBE {name})"""
    for name in PROFILED))
def profile_database(t):
    profiles = integrity.profile_database({name: getattr(t, name) for name in PROFILED}, {"orders": ["o_orderkey"]})
    return profiles.select("table", "column", "row_count", "null_count")


@plan("d16_database_totals", """
SELECT count(*) AS total_tables, CAST(sum(n) AS BIGINT) AS total_rows FROM
(SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM lineitem UNION ALL SELECT count(*) FROM documents UNION ALL SELECT count(*) FROM events)
""")
def database_totals(t):
    return integrity.database_totals(integrity.profile_database(
        {"orders": t.orders, "lineitem": t.lineitem, "documents": t.documents, "events": t.events}))


def backup_log(t):
    """Events as lines of one backup log per user, numbered by event."""
    line = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("piece handle=/backup/"), F.col("event_id")))
        .when(F.col("event_type") == "view", F.concat(F.lit("input datafile size="), F.floor("value").cast("string"), F.lit("M")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit("output size="), F.floor("value").cast("string"), F.lit("K done")))
        .when((F.col("event_type") == "error") & (F.col("value") > 50),
              F.concat(F.lit("ORA-"), F.floor("value").cast("string"), F.lit(": failure")))
        .when((F.col("event_type") == "error") & (F.col("value") > 49), F.lit("validation failed"))
        .otherwise(F.lit("channel open"))
    )
    return t.events.select(F.concat(F.lit("log-"), F.col("user_id")).alias("path"), F.col("event_id").alias("line_no"),
                           line.alias("value"))


@plan("d17_backup_log_summary", """
SELECT 'log-' || user_id AS path, count(*) AS lines, count(*) FILTER (event_type = 'click') AS pieces,
       coalesce(arg_max(CAST(floor(value) AS BIGINT) || 'M', event_id) FILTER (event_type = 'view'), 'Unknown') AS input_size,
       coalesce(arg_max(CAST(floor(value) AS BIGINT) || 'K', event_id) FILTER (event_type = 'purchase'), 'Unknown') AS output_size,
       count(*) FILTER (event_type = 'error' AND value > 50) AS error_lines,
       CASE WHEN count(*) FILTER (event_type = 'error' AND value > 49 AND value <= 50) > 0 THEN 'ISSUES_FOUND' ELSE 'VALID' END AS validation
FROM events GROUP BY user_id
""")
def backup_log_summary(t):
    return op.backup_log_summary(backup_log(t))


@plan("d17_backup_log_errors", """
SELECT 'log-' || user_id AS path, event_id AS line_no, 'ORA-' || CAST(floor(value) AS BIGINT) || ': failure' AS value,
       'ORA-' || CAST(floor(value) AS BIGINT) AS codes FROM events WHERE event_type = 'error' AND value > 50
""")
def backup_log_errors(t):
    return op.backup_log_errors(backup_log(t)).withColumn("codes", F.array_join("codes", ","))


@plan("d17_log_tail", """
SELECT 'log-' || user_id AS path, event_id AS line_no FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10
""")
def log_tail(t):
    return op.log_tail(backup_log(t)).select("path", "line_no")
