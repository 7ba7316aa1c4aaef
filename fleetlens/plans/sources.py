"""Readers and writers, fed with text and files made from the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import movement, reports
from ..sources import backup_reports, exports, files, logs, telemetry
from ..workspace import new_dir
from .registry import TABLE_NAMES, plan



@plan("a01_read_telemetry", "SELECT event_id, ts, user_id, value FROM events WHERE event_type = 'error'")
def read_telemetry(t):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    landed = telemetry.read_telemetry(t.spark, t.path("events"), schema=schema)
    return landed.filter(F.col("event_type") == "error").select("event_id", "ts", "user_id", "value")


EVENT_LINE = "event_id long, user_id long, event_type string, value double"


def broken_lines(t, fmt):
    """Events as text lines, some cut off in the middle, some with a word for a number."""
    path = new_dir(t.spark, "broken")
    value = F.when(F.col("event_id") % 50 == 8, F.lit("unknown")).otherwise(F.format_string("%.4f", "value"))
    if fmt == "json":
        line = F.format_string('{"event_id": %d, "user_id": %d, "event_type": "%s", "value": %s}', "event_id", "user_id", "event_type", value)
    else:
        line = F.concat_ws(",", "event_id", "user_id", "event_type", value)
    whole = F.col("event_id") % 50 != 7
    t.events.select(F.when(whole, line).otherwise(F.substr(line, F.lit(1), F.lit(9) if fmt == "json" else F.lit(2)))).write.text(path)
    return telemetry.read_quarantined(t.spark, path, fmt=fmt, schema=EVENT_LINE)


@plan("a01_quarantine_good_rows", """
SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events WHERE event_id % 50 NOT IN (7, 8)
""")
def quarantine_good_rows(t):
    good, _ = broken_lines(t, "json")
    return good.withColumn("value", F.round("value", 4))


@plan("a01_quarantine_counts", """
SELECT fmt, count(*) FILTER (event_id % 50 NOT IN (7, 8)) AS good, count(*) FILTER (event_id % 50 IN (7, 8)) AS bad
FROM events, (SELECT unnest(['json', 'csv']) AS fmt) GROUP BY fmt
""")
def quarantine_counts(t):
    parts = [rows.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.lit(kind).alias("kind"))
             for fmt in ("json", "csv") for kind, rows in zip(("good", "bad"), broken_lines(t, fmt))]
    return reduce(DataFrame.unionByName, parts).groupBy("fmt").agg(
        *[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in ("good", "bad")])


def report_fields(t):
    """Header name to value, from events."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    kib = F.concat(F.floor("value").cast("string"), F.lit(".0K"))
    known = F.when(F.col("event_type") == "error", F.lit("Unknown")).otherwise(kib)
    return {
        "Timestamp": stamp, "Host": F.concat(F.lit("h"), "user_id"), "Instance": F.concat(F.lit("h"), "user_id"),
        "Server": F.concat(F.lit("h"), "user_id"), "Version": F.lit("v2"), "Database": F.concat(F.lit("db"), "event_id"),
        "Database_Bucket": F.concat(F.lit("db"), "event_id"), "Oracle_SID": F.concat(F.lit("db"), "event_id"),
        "BackupType": F.lit("FULL"), "Backup_Type": F.lit("FULL"), "Status": F.col("event_type"),
        "BackupFile": F.lit("/b/f"), "BackupPath": F.lit("/b/f"), "Backup_Dir": F.lit("/b/f"), "Size": known,
        "SizeMB": F.floor("value").cast("string"), "Duration": F.lit("N/A"),
        "Duration_sec": F.floor("value").cast("string"), "Duration(s)": F.floor("value").cast("string"),
    }


@plan("a02_read_backup_reports", """
WITH e AS (SELECT date_trunc('second', ts) AS ts, 'h' || user_id AS h, 'db' || event_id AS db, event_type AS st, CAST(floor(value) AS BIGINT) AS v,
  CASE WHEN event_type = 'error' THEN 'Unknown' ELSE CAST(floor(value) AS BIGINT) || '.0K' END AS sz,
  CASE WHEN event_type <> 'error' THEN floor(value) * 1024.0::DOUBLE END AS b FROM events)
SELECT 'influxdb' AS layout, ts, h AS server, db AS database, NULL AS kind, st AS status, '/b/f' AS path, sz AS size_text, b AS size_bytes, v::DOUBLE AS duration_seconds FROM e
UNION ALL SELECT 'db2', ts, h, db, 'FULL', st, '/b/f', sz, b, v::DOUBLE FROM e
UNION ALL SELECT 'mysql', ts, h, db, NULL, st, '/b/f', sz, b, v::DOUBLE FROM e
UNION ALL SELECT 'oracle', ts, NULL, db, 'FULL', st, '/b/f', NULL, NULL, NULL FROM e
UNION ALL SELECT 'postgresql', ts, NULL, db, NULL, st, '/b/f', sz, b, NULL FROM e
UNION ALL SELECT 'sqlserver', ts, h, db, 'FULL', st, '/b/f', v::VARCHAR, v * 1048576.0::DOUBLE, NULL FROM e
UNION ALL SELECT 'postgresql_windows', ts, NULL, db, NULL, st, '/b/f', sz, b, NULL FROM e
""")
def read_backup_reports(t):
    fields, root = report_fields(t), new_dir(t.spark, "reports")
    paths = {layout: f"{root}/{layout}" for layout in backup_reports.LAYOUTS}
    for layout, header in backup_reports.LAYOUTS.items():
        t.events.select(*[fields[name].alias(name) for name in header.split(",")]).write.option("header", True).csv(paths[layout])
    return backup_reports.read_backup_reports(t.spark, paths).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("a03_append_report", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def append_report(t):
    path = new_dir(t.spark, "report")
    rows = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    for status in ("O", "F", "P", "O"):  # the repeated run replaces itself
        backup_reports.append_report(rows.filter(F.col("o_orderstatus") == status), path, f"run-{status}")
    return backup_reports.read_report(t.spark, path).drop("run_id")


def log_lines(t):
    """Events as log lines, one log per day; the layout changes with the time of day."""
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARN").otherwise("INFO")
    text = F.concat(F.lit("event "), "event_id")
    hour = F.hour("ts")
    line = (
        F.when(hour < 5, F.concat(F.lit("["), stamp, F.lit("] ["), level, F.lit("] "), text))
        .when(hour < 10, F.concat(F.lit("\x1b[0;31m["), stamp, F.lit("] "), level, F.lit(": "), text, F.lit("\x1b[0m")))
        .when(hour < 15, F.concat(stamp, F.lit(",123 - "), level, F.lit(" - "), text))
        .when(hour < 20, F.concat(F.lit("["), stamp, F.lit("] "), text))
        .otherwise(F.concat(F.lit("no layout: "), text))
    )
    return t.events.select(F.concat(F.lit("day"), F.date_format("ts", "yyyyMMdd")).alias("path"), line.alias("value"))


LOG_SQL = """
l AS (SELECT strftime(ts, 'day%Y%m%d') AS source, CASE WHEN hour(ts) < 20 THEN date_trunc('second', ts) END AS ts,
  CASE WHEN hour(ts) < 15 THEN CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'WARN' ELSE 'INFO' END END AS level,
  CASE WHEN hour(ts) >= 20 THEN 'no layout: ' ELSE '' END || 'event ' || event_id AS message,
  CASE WHEN hour(ts) < 5 THEN 'bracketed' WHEN hour(ts) < 10 THEN 'colon' WHEN hour(ts) < 15 THEN 'dashed' WHEN hour(ts) < 20 THEN 'plain' END AS layout FROM events)
"""


@plan("a04_parse_logs", f"WITH {LOG_SQL} SELECT * FROM l")
def parse_logs(t):
    path = new_dir(t.spark, "logs")
    log_lines(t).withColumnRenamed("path", "log").write.partitionBy("log").text(path)
    lines = t.spark.read.text(path).select(F.col("log").alias("path"), "value")
    return logs.parse_logs(lines).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@plan("a04_log_levels", f"WITH {LOG_SQL} SELECT source, level, count(*) AS lines FROM l GROUP BY source, level")
def log_levels(t):
    return logs.level_counts(logs.parse_logs(log_lines(t)))


@plan("a04_log_levels_of_files", f"WITH {LOG_SQL} SELECT level, count(*) AS lines FROM l GROUP BY level")
def log_levels_of_files(t):
    path = new_dir(t.spark, "logs")
    log_lines(t).select("value").write.text(path)
    counts = logs.level_counts(logs.parse_logs(logs.read_lines(t.spark, path)))
    return counts.groupBy("level").agg(F.sum("lines").alias("lines"))


@plan("a05_write_report_json", """
SELECT c_custkey AS server_id, c_mktsegment AS segment, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL
""")
def write_report_json(t):
    path = new_dir(t.spark, "json-report")
    counts = t.orders.groupBy(F.col("o_custkey").alias("server_id")).agg(F.count("*").alias("orders"))
    info = t.customer.select(F.col("c_custkey").alias("server_id"), F.col("c_mktsegment").alias("segment"))
    exports.write_report_json(reports.server_report({"info": info, "totals": counts}, ["server_id"]), path)
    schema = "server_id long, info struct<segment:string>, totals struct<orders:long>"
    return t.spark.read.schema(schema).json(path).select(
        "server_id", "info.segment", F.coalesce("totals.orders", F.lit(0)).alias("orders"))


# Events with instants to the microsecond inside a struct and an array, a line break, an empty text and a NULL.
NESTED_SQL = """
SELECT event_id, ts, ts + INTERVAL 1 MICROSECOND AS inner_ts, ts + INTERVAL 2 MICROSECOND AS listed_ts,
  CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type || chr(10) || props WHEN 2 THEN '%0A"' || event_type END AS note FROM events
"""


def nested_events(t):
    ts, turn = F.col("ts"), F.col("event_id") % 4
    return t.events.select(
        "event_id", "ts", F.struct((ts + F.expr("INTERVAL '0.000001' SECOND")).alias("at")).alias("inner"),
        F.array(ts + F.expr("INTERVAL '0.000002' SECOND")).alias("listed"),
        F.when(turn == 0, F.lit("")).when(turn == 1, F.concat("event_type", F.lit("\n"), "props"))
        .when(turn == 2, F.concat(F.lit('%0A"'), "event_type")).alias("note"))


def flat_events(df):
    return df.select("event_id", "ts", F.col("inner.at").alias("inner_ts"), F.col("listed")[0].alias("listed_ts"), "note")


@plan("a05_write_report_json_nested", NESTED_SQL)
def write_report_json_nested(t):
    path, df = new_dir(t.spark, "json-report"), nested_events(t)
    exports.write_report_json(df, path)
    return flat_events(t.spark.read.schema(df.schema).json(path))


@plan("a06_write_report_csv", """
SELECT event_type AS metric, max(value) AS maximum, count(*) AS points, max(ts) AS latest FROM events GROUP BY event_type
""")
def write_report_csv(t):
    path = new_dir(t.spark, "csv-report")
    report = t.events.groupBy(F.col("event_type").alias("metric")).agg(
        F.max("value").alias("maximum"), F.count("*").alias("points"), F.max("ts").alias("latest"))
    exports.write_report_csv(report, path)
    return exports.read_table(t.spark, path, report.schema)


@plan("a06_write_report_csv_texts", NESTED_SQL)
def write_report_csv_texts(t):
    path, df = new_dir(t.spark, "csv-report"), nested_events(t)
    exports.write_report_csv(df, path)
    return flat_events(exports.read_table(t.spark, path, df.schema))


@plan("a07_export_ndjson_nested", NESTED_SQL)
def export_ndjson_nested(t):
    path, df = new_dir(t.spark, "ndjson"), nested_events(t)
    exports.export_ndjson(df, path)
    return flat_events(t.spark.read.schema(df.schema).json(path))


@plan("a08_export_nested", NESTED_SQL)
def export_nested(t):
    path = new_dir(t.spark, "export")
    exports.export_database(t.spark, {"events": nested_events(t)}, path, "nightly")
    return flat_events(exports.restore_database(t.spark, path)["events"])


@plan("a07_export_ndjson", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def export_ndjson(t):
    path = new_dir(t.spark, "ndjson")
    exports.export_ndjson(t.documents, path)
    return t.spark.read.schema(t.documents.schema).json(path)


# Length of an event as a line of JSON, with its line break.
LINE_SQL = """length('{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}') + 1"""


@plan("a07_export_ndjson_stats", f"""
SELECT count(*) AS documents, true AS written, CAST(sum({LINE_SQL}) AS BIGINT) AS bytes, sum({LINE_SQL})::DOUBLE / count(*)::DOUBLE AS avg_document_bytes FROM events
""")
def export_ndjson_stats(t):
    size = exports.export_ndjson(t.events.select("event_id", "user_id", "event_type"), new_dir(t.spark, "ndjson"), compression="none")
    return size.select("documents", (F.col("files") > 0).alias("written"), "bytes", "avg_document_bytes")


def all_tables(t):
    return {name: getattr(t, name) for name in TABLE_NAMES}


COUNT_SQL = " UNION ALL ".join(f"""SELECT '{name}' AS "table", count(*) AS rows FROM {name}""" for name in TABLE_NAMES)


@plan("a08_export_database", COUNT_SQL)
def export_database(t):
    path = new_dir(t.spark, "export")
    return exports.export_database(t.spark, all_tables(t), path, "nightly").select("table", "rows")


@plan("a09_export_sql_dump", """
SELECT 'INSERT INTO "customer" VALUES(' || c_custkey || ',''' || c_name || ''',' || c_nationkey || ',' || c_acctbal || ',''' || c_mktsegment || ''');' AS value FROM customer
""")
def export_sql_dump(t):
    path = new_dir(t.spark, "dump")
    exports.export_sql_dump(t.customer, "customer", path)
    return t.spark.read.text(f"{path}/data")


@plan("a09_sql_dump_values", """
SELECT 'INSERT INTO "d 1" VALUES(' || doc_id || ',' || q || replace(text, q, q || q) || q || ',X' || q || hex(encode(source)) || q || ',' || q || '["' || lang || '",null]' || q || ','
  || CASE doc_id % 4 WHEN 0 THEN q || 'NaN' || q WHEN 1 THEN q || 'Infinity' || q WHEN 2 THEN '0.5' ELSE 'NULL' END || ');' AS value
FROM (SELECT *, chr(39) AS q FROM documents) WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL
""")
def sql_dump_values(t):
    turn = F.col("doc_id") % 4
    known = t.documents.filter("text is not null and source is not null and lang is not null")
    return exports.insert_statements(known.select(
        "doc_id", "text", F.col("source").cast("binary").alias("b"), F.array("lang", F.lit(None)).alias("list"),
        F.when(turn == 0, float("nan")).when(turn == 1, float("inf")).when(turn == 2, 0.5).alias("number")), 'd 1')


@plan("a10_export_schema", "SELECT * FROM orders")
def export_schema(t):
    """The rows of a table recreated from the exported schema alone."""
    path = new_dir(t.spark, "schema")
    exports.export_schema(t.spark, all_tables(t)).write.json(f"{path}/schema")
    return t.spark.read.schema(exports.read_schemas(t.spark, path)["orders"]).parquet(t.path("orders"))


@plan("a11_restore_orders", "SELECT * FROM orders")
def restore_orders(t):
    path = new_dir(t.spark, "restore")
    exports.export_database(t.spark, {"orders": t.orders, "nation": t.nation}, path, "nightly", parallelism=4)
    return exports.restore_database(t.spark, path)["orders"]


@plan("a11_restore_into_orders", "SELECT * FROM orders")
def restore_into_orders(t):
    """An export read back as managed tables of another database."""
    path, name = new_dir(t.spark, "restore"), f"restored_{uuid.uuid4().hex}"
    exports.export_database(t.spark, {"orders": t.orders, "nation": t.nation}, path, "nightly", parallelism=4)
    exports.restore_into(t.spark, path, name, new_dir(t.spark, "database"))
    return t.spark.table(f"{name}.orders")


@plan("a11_restore_documents", "SELECT * FROM documents")
def restore_documents(t):
    path = new_dir(t.spark, "restore")
    exports.export_database(t.spark, {"documents": t.documents}, path, "nightly")
    return exports.restore_database(t.spark, path)["documents"]


VERIFY_NAMES = ["lineitem", "events", "documents", "embeddings", "pages", "conversations"]


@plan("a11_restore_verified", " UNION ALL ".join(
    f"""SELECT '{name}' AS "table", count(*) AS source_rows, count(*) AS copy_rows, true AS rows_match, true AS content_matches FROM {name}"""
    for name in VERIFY_NAMES))
def restore_verified(t):
    path = new_dir(t.spark, "restore")
    tables = {name: getattr(t, name) for name in VERIFY_NAMES}
    exports.export_database(t.spark, tables, path, "nightly")
    copies = exports.restore_database(t.spark, path)
    parts = [movement.verify_copy(df, copies[name], name) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@plan("a12_compression_report", f"""
SELECT CAST(sum({LINE_SQL}) AS BIGINT) AS original_bytes, true AS smaller, true AS consistent FROM events
""")
def compression_report(t):
    root = new_dir(t.spark, "compress")
    report = exports.write_compressed(t.events.select("event_id", "user_id", "event_type"), f"{root}/plain", f"{root}/packed")
    packed, plain = F.col("compressed_bytes"), F.col("original_bytes")
    return report.select("original_bytes", (packed.between(1, plain - 1)).alias("smaller"), (F.col("ratio") == packed / plain).alias("consistent"))


@plan("a13_file_inventory", """
SELECT 'event_type=' || event_type AS folder, CAST(sum(length(event_id::VARCHAR) + 1) AS BIGINT) AS bytes, true AS dated FROM events GROUP BY event_type
""")
def file_inventory(t):
    """Bytes by folder of an export of events, one folder for each type."""
    path = new_dir(t.spark, "inventory")
    t.events.select("event_type", F.col("event_id").cast("string").alias("value")).write.partitionBy("event_type").text(path)
    sizes = files.directory_sizes(files.file_inventory(t.spark, path))
    return sizes.select(F.regexp_extract("directory", "[^/]*$", 0).alias("folder"), "bytes",
                        ((F.col("files") > 0) & F.col("modified").isNotNull()).alias("dated"))
