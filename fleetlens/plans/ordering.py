"""Sorting, top-n and unions on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, ordering as op
from .registry import plan
from .shapes import TRIAGE_SQL, triage


@plan("f01_top_n", f"""
WITH {TRIAGE_SQL}
SELECT object_id, operation, page_count, fragmentation_percent FROM triage WHERE operation <> 'NONE'
ORDER BY priority, fragmentation_percent DESC, page_count DESC, object_id LIMIT 50
""")
def top_n(t):
    work = triage(t).filter(F.col("operation") != "NONE")
    order = [F.asc("priority"), F.desc("fragmentation_percent"), F.desc("page_count"), F.asc("object_id")]
    return op.top_n(work, order, 50).select("object_id", "operation", "page_count", "fragmentation_percent")


@plan("f02_order_by_list", """
SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority
""")
def order_by_list(t):
    counts = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("count"))
    return op.order_by_list(counts, "o_orderpriority", ["5-LOW", "1-URGENT", "3-MEDIUM"])


@plan("f03_recent", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent(t):
    return op.recent(t.events.select("event_id", "ts", "event_type"), "ts", 10, tie=["event_id"])


@plan("f04_preview", "SELECT least(count(*), 5) AS listed, least(count(*), 5) AS known FROM events")
def preview(t):
    """Which rows come is left open: how many, and how many of them are rows of the table."""
    some = op.preview(t.events.select("event_id", "ts", "value"), 5)
    found = t.events.select(F.struct("event_id", "ts", "value").alias("row"), F.lit(1).alias("hit"))
    return some.select(F.struct("event_id", "ts", "value").alias("row")).join(found, "row", "left").agg(
        F.count("*").alias("listed"), F.count("hit").alias("known"))


@plan("g01_metrics_long", """
SELECT l_returnflag, 'quantity' AS metric, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS value FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'lines', count(*) FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'largest_order', max(l_orderkey) FROM lineitem GROUP BY 1
""")
def metrics_long(t):
    wide = t.lineitem.groupBy("l_returnflag").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("q"), F.count("*").alias("n"), F.max("l_orderkey").alias("m"))
    return aggregates.metric_rows(wide, {"quantity": F.col("q"), "lines": F.col("n"), "largest_order": F.col("m")},
                                  keys=["l_returnflag"])


@plan("g02_union_tagged", """
SELECT c_name AS name, c_nationkey AS nationkey, c_mktsegment AS segment, 'Instance' AS type FROM customer
UNION ALL SELECT s_name, s_nationkey, NULL, 'Cluster' FROM supplier
""")
def union_tagged(t):
    customers = t.customer.select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"),
                                  F.col("c_mktsegment").alias("segment"))
    suppliers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"))
    return op.union_tagged({"Instance": customers, "Cluster": suppliers})
