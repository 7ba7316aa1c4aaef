"""Ordered comparisons on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as op
from .registry import ORDERS_AS_OF, plan
from .shapes import backup_sets, cents


@plan("e01_maintenance_plan", """
WITH w AS (SELECT l_suppkey AS server_id, l_orderkey AS object_id, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS estimated,
                  CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END AS priority, l_discount * 100 AS fragmentation_percent, CAST(l_quantity AS BIGINT) AS page_count
           FROM lineitem WHERE l_returnflag <> 'N'),
     r AS (SELECT *, coalesce(sum(estimated) OVER (PARTITION BY server_id ORDER BY priority, fragmentation_percent DESC, page_count DESC, object_id, l_partkey, l_linenumber
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS elapsed_before FROM w)
SELECT server_id, object_id, l_partkey, l_linenumber, estimated, elapsed_before FROM r WHERE elapsed_before < 240
""")
def maintenance_plan(t):
    work = t.lineitem.select(
        F.col("l_suppkey").alias("server_id"), F.col("l_orderkey").alias("object_id"), "l_partkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("priority"),
        F.when(F.col("l_returnflag") == "R", "REBUILD").when(F.col("l_returnflag") == "A", "REORGANIZE")
        .otherwise("NONE").alias("operation"),
        (F.col("l_discount") * 100).alias("fragmentation_percent"), F.col("l_quantity").cast("long").alias("page_count"))
    return op.maintenance_plan(work, 240, F.col("page_count"), by=["server_id"],
                               tie=["object_id", "l_partkey", "l_linenumber"]).select(
        "server_id", "object_id", "l_partkey", "l_linenumber", "estimated", "elapsed_before")


@plan("e01_maintenance_plan_unknown_pages", """
WITH w AS (SELECT l_suppkey AS server_id, l_orderkey AS object_id, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS estimated,
                  CASE l_returnflag WHEN 'R' THEN 1 ELSE 2 END AS priority, CASE WHEN l_partkey % 5 <> 0 THEN l_discount * 100 END AS fragmentation_percent,
                  CASE WHEN l_orderkey % 3 <> 0 THEN CAST(l_quantity AS BIGINT) END AS page_count
           FROM lineitem WHERE l_returnflag <> 'N'),
     r AS (SELECT *, coalesce(sum(estimated) OVER (PARTITION BY server_id ORDER BY priority, fragmentation_percent DESC NULLS LAST, page_count DESC NULLS LAST, object_id, l_partkey, l_linenumber
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS elapsed_before FROM w)
SELECT server_id, object_id, l_partkey, l_linenumber, estimated, elapsed_before FROM r WHERE elapsed_before < 2400
""")
def maintenance_plan_unknown_pages(t):
    work = t.lineitem.select(
        F.col("l_suppkey").alias("server_id"), F.col("l_orderkey").alias("object_id"), "l_partkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("priority"),
        F.when(F.col("l_returnflag") == "N", "NONE").otherwise("REBUILD").alias("operation"), F.col("l_quantity").cast("long").alias("minutes"),
        F.when(F.col("l_partkey") % 5 != 0, F.col("l_discount") * 100).alias("fragmentation_percent"),
        F.when(F.col("l_orderkey") % 3 != 0, F.col("l_quantity").cast("long")).alias("page_count"))
    return op.maintenance_plan(work, 2400, F.col("minutes"), by=["server_id"],
                               tie=["object_id", "l_partkey", "l_linenumber"]).select(
        "server_id", "object_id", "l_partkey", "l_linenumber", "estimated", "elapsed_before")


@plan("e02_latest_n", """
SELECT o_custkey, o_orderkey, o_orderdate FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n <= 3
""")
def latest_n(t):
    from ..operators.ordering import latest_n as latest
    slim = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return latest(slim, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 3)


@plan("e03_counter_rate", """
WITH p AS (SELECT user_id, event_id, CAST(round(value * 100) AS BIGINT) AS ops,
                  lag(CAST(round(value * 100) AS BIGINT)) OVER w AS before, lag(ts) OVER w AS ts0, ts
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, ops, (epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE AS elapsed_seconds, coalesce(ops < before, false) AS ops_reset,
       CASE WHEN ops >= before THEN ops - before END AS ops_delta,
       CASE WHEN ops >= before THEN (ops - before)::DOUBLE / nullif((epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE, 0) END AS ops_rate
FROM p
""")
def counter_rate(t):
    counters = t.events.select("user_id", "event_id", "ts", cents("value").alias("ops"))
    return op.counter_rate(counters, ["user_id"], "ts", ["ops"], tie=["event_id"]).drop("ts")


@plan("e03_counter_rate_undated", """
WITH v AS (SELECT CASE WHEN user_id % 3 = 0 THEN 0 WHEN user_id % 11 <> 1 THEN user_id END AS server, event_id,
                  CAST(round(value * 100) AS BIGINT) AS ops, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts FROM events),
     p AS (SELECT server, event_id, ops, CASE WHEN server IS NOT NULL THEN lag(ops) OVER w END AS before,
                  CASE WHEN server IS NOT NULL THEN lag(ts) OVER w END AS ts0, ts
           FROM v WINDOW w AS (PARTITION BY server ORDER BY ts NULLS FIRST, event_id))
SELECT server, event_id, ops, (epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE AS elapsed_seconds, coalesce(ops < before, false) AS ops_reset,
       CASE WHEN ops >= before THEN ops - before END AS ops_delta,
       CASE WHEN ops >= before THEN (ops - before)::DOUBLE / nullif((epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE, 0) END AS ops_rate
FROM p
""")
def counter_rate_undated(t):
    """A third of the rows on one key, rows without an instant and rows without a key."""
    user = F.col("user_id")
    counters = t.events.select(
        F.when(user % 3 == 0, 0).when(user % 11 != 1, user).alias("server"), "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), cents("value").alias("ops"))
    return op.counter_rate(counters, ["server"], "ts", ["ops"], tie=["event_id"]).drop("ts")


HOT_SQL = """
h AS (SELECT CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS server, event_id, CAST(round(value * 100) AS BIGINT) AS ops,
             CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-15 12:00:00' + INTERVAL 1 MICROSECOND * (event_id % 1000000) ELSE ts END AS ts FROM events)
"""


def hot_events(t):
    """A third of all rows on one server, within one second."""
    hot = F.col("event_id") % 3 == 0
    second = F.timestamp_micros(F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp")) + F.col("event_id") % 1_000_000)
    return t.events.select(F.when(hot, -1).otherwise(F.col("user_id")).alias("server"), "event_id", cents("value").alias("ops"),
                           F.when(hot, second.cast("timestamp_ntz")).otherwise(F.col("ts")).alias("ts"))


@plan("e03_counter_rate_hot_second", f"""
WITH {HOT_SQL}, p AS (SELECT *, lag(ops) OVER w AS before, lag(ts) OVER w AS ts0 FROM h WINDOW w AS (PARTITION BY server ORDER BY ts, event_id))
SELECT server, event_id, ops, (epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE AS elapsed_seconds, coalesce(ops < before, false) AS ops_reset,
       CASE WHEN ops >= before THEN ops - before END AS ops_delta,
       CASE WHEN ops >= before THEN (ops - before)::DOUBLE / nullif((epoch_us(ts) - epoch_us(ts0)) / 1e6::DOUBLE, 0) END AS ops_rate
FROM p
""")
def counter_rate_hot_second(t):
    return op.counter_rate(hot_events(t), ["server"], "ts", ["ops"], tie=["event_id"], rows=2000).drop("ts")


@plan("e06_run_intervals_hot_second", f"""
WITH {HOT_SQL}
SELECT server, event_id, ops, 3600::BIGINT AS duration_seconds,
       date_diff('second', lag(ts) OVER (PARTITION BY server ORDER BY ts, event_id), ts) AS interval_seconds FROM h
""")
def run_intervals_hot_second(t):
    runs = hot_events(t).withColumnRenamed("ts", "start").withColumn("finish", F.col("start") + F.expr("INTERVAL 1 HOUR"))
    return op.run_intervals(runs, ["server"], tie=["event_id"], rows=2000).drop("start", "finish")


@plan("e01_maintenance_plan_one_value", """
WITH w AS (SELECT l_orderkey AS object_id, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) AS estimated FROM lineitem),
     r AS (SELECT *, CAST(coalesce(sum(estimated) OVER (ORDER BY object_id, l_partkey, l_linenumber, estimated ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS elapsed_before FROM w)
SELECT object_id, l_partkey, l_linenumber, estimated, elapsed_before FROM r WHERE elapsed_before < (SELECT sum(estimated) FROM w) / 2
""")
def maintenance_plan_one_value(t):
    """One server, all of whose items tie in priority, percent and pages; half of the whole work fits."""
    work = t.lineitem.select(F.col("l_orderkey").alias("object_id"), "l_partkey", "l_linenumber", F.lit(1).alias("priority"), F.lit("REBUILD").alias("operation"),
                             F.lit(50.0).alias("fragmentation_percent"), F.lit(1000).alias("page_count"), F.col("l_quantity").cast("long").alias("minutes"))
    budget = work.agg(F.sum("minutes") / 2).scalar()
    return op.maintenance_plan(work, budget, F.col("minutes"), by=None, tie=["object_id", "l_partkey", "l_linenumber", "minutes"], rows=4000).select(
        "object_id", "l_partkey", "l_linenumber", "estimated", "elapsed_before")


@plan("e03_size_growth", """
SELECT o_custkey AS database, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes,
  CAST(round(o_totalprice * 100) AS BIGINT) - lag(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS bytes_growth,
  (CAST(round(o_totalprice * 100) AS BIGINT) - lag(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w)::DOUBLE
   / nullif((epoch_us(o_orderdate) - epoch_us(lag(o_orderdate) OVER w)) / 1e6::DOUBLE / 86400.0::DOUBLE, 0) AS bytes_per_day
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def size_growth(t):
    sizes = t.orders.select(F.col("o_custkey").alias("database"), "o_orderkey", "o_orderdate", cents("o_totalprice").alias("bytes"))
    return op.size_growth(sizes, ["database"], "o_orderdate", ["bytes"], tie=["o_orderkey"]).drop("o_orderdate")


@plan("e04_long_term_retention", """
WITH b AS (SELECT o_custkey AS database, o_orderkey AS backup_id, o_orderdate AS created,
   row_number() OVER (PARTITION BY o_custkey, date_trunc('week', o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1 AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 84 DAY AS weekly,
   row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1 AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 12 MONTH AS monthly,
   row_number() OVER (PARTITION BY o_custkey, date_trunc('year', o_orderdate) ORDER BY o_orderdate, o_orderkey) = 1 AND o_orderdate >= TIMESTAMP '2001-08-01' - INTERVAL 5 YEAR AS yearly
   FROM orders)
SELECT * FROM b WHERE weekly OR monthly OR yearly
""")
def long_term_retention(t):
    return op.ltr_keep(backup_sets(t), ORDERS_AS_OF)


@plan("e05_sequence_gaps", """
SELECT c_mktsegment AS source, seq + 1 AS gap_from, after - 1 AS gap_to, after - seq - 1 AS missing FROM
(SELECT c_mktsegment, o_orderkey AS seq, lead(o_orderkey) OVER (PARTITION BY c_mktsegment ORDER BY o_orderkey) AS after
 FROM orders JOIN customer ON o_custkey = c_custkey) WHERE after > seq + 1
""")
def sequence_gaps(t):
    segments = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source"))
    applied = t.orders.select("o_custkey", F.col("o_orderkey").alias("seq")).join(segments, "o_custkey")
    return op.sequence_gaps(applied, ["source"], "seq")


@plan("e05_sequence_gaps_repeated", """
WITH a AS (SELECT DISTINCT c_mktsegment AS source, o_orderkey // 2 AS seq FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 5 <> 0)
SELECT source, seq + 1 AS gap_from, after - 1 AS gap_to, after - seq - 1 AS missing FROM
(SELECT source, seq, lead(seq) OVER (PARTITION BY source ORDER BY seq) AS after FROM a) WHERE after > seq + 1
""")
def sequence_gaps_repeated(t):
    segments = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("source"))
    number = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_orderkey") / 2).cast("long"))
    applied = t.orders.select("o_custkey", number.alias("seq")).join(segments, "o_custkey")
    return op.sequence_gaps(applied, ["source"], "seq", width=100)


@plan("e06_run_intervals", """
SELECT o_custkey AS database, o_orderkey AS run_id, 3600::BIGINT AS duration_seconds,
       date_diff('second', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate) AS interval_seconds
FROM orders
""")
def run_intervals(t):
    runs = t.orders.select(F.col("o_custkey").alias("database"), F.col("o_orderkey").alias("run_id"),
                           F.col("o_orderdate").alias("start"),
                           (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("finish"))
    return op.run_intervals(runs, ["database"], tie=["run_id"]).drop("start", "finish")
