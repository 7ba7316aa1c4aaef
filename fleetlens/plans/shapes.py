"""Driver tables in the shape of telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands


def money(col: str):
    """Price as an exact number, so that sums do not depend on their order."""
    return F.col(col).cast("decimal(12,2)")


def cents(col: str):
    return F.round(F.col(col) * 100).cast("long")


def order_fragmentation(t):
    """Orders as indexes: pages are lines, fragmentation is the returned share of the quantity."""
    quantity = F.col("l_quantity").cast("long")
    returned = F.when(F.col("l_returnflag") == "R", quantity).otherwise(0)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("object_id")).agg(
        F.count("*").alias("page_count"),
        (F.sum(returned) * 100).cast("double").alias("_part"), F.sum(quantity).cast("double").alias("_all"),
    ).select("object_id", "page_count",
             F.try_divide("_part", "_all").alias("avg_fragmentation_in_percent"))


TRIAGE_SQL = """
f AS (SELECT l_orderkey AS object_id, count(*) AS page_count,
             (coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (l_returnflag = 'R'), 0) * 100)::DOUBLE / sum(CAST(l_quantity AS BIGINT))::DOUBLE AS fragmentation_percent
      FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3),
triage AS (SELECT *, CASE WHEN fragmentation_percent >= 30 THEN 'REBUILD' WHEN fragmentation_percent >= 5 THEN 'REORGANIZE' ELSE 'NONE' END AS operation,
             CASE WHEN fragmentation_percent >= 30 THEN 1 WHEN fragmentation_percent >= 5 THEN 2 ELSE 3 END AS priority FROM f)
"""


def triage(t):
    from ..operators.rules import fragmentation_triage
    return fragmentation_triage(order_fragmentation(t), min_pages=3)


def backup_sets(t):
    """Orders as backups: one database per customer, kind by priority, size is the price in cents."""
    return t.orders.select(
        F.col("o_custkey").alias("database"), F.col("o_orderkey").alias("backup_id"),
        bands.decode("o_orderpriority", {"1-URGENT": "D", "2-HIGH": "I"}, "L").alias("type"),
        F.col("o_orderdate").alias("created"), cents("o_totalprice").alias("bytes"),
        F.col("o_orderstatus").alias("status"),
    )
