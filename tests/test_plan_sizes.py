"""How large plans are: the driver holds each copy of a plan that a query reads several times."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import backup, chunks


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def tables(spark, tmp_path):
    start = dt.datetime(1997, 12, 1)
    orders = [(i, i % 3, "F", 10.0 + i, start + dt.timedelta(days=i), ["1-URGENT", "3-MEDIUM", "5-LOW"][i // 3 % 3]) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
                          ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(3).select(F.col("id").alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_restore_member_counts_does_not_plan_its_chains_again(spark, tables):
    counts = entry.queries()["k07_restore_member_counts"](spark, tables)
    plan = plan_of(counts)
    assert plan.count("FileScan") <= 16
    assert counts.agg(F.sum("logs")).first()[0] == entry.queries()["k07_restore_chain"](spark, tables).agg(F.sum("logs")).first()[0] > 0


def test_a_cut_is_looked_up_by_one_join(spark):
    data, keys = chunks._prepared(spark.range(1000).select((F.col("id") % 3).alias("k"), "id"), ["k"])
    for side in chunks._cut(data, keys, ["id"], 50):
        # One more finds the rows to sample.
        assert plan_of(side).count("BroadcastHashJoin") <= 2


def test_spans_are_summed_over_the_borders_of_their_chunks(spark, monkeypatch):
    monkeypatch.setattr(backup, "SPANS", 3)
    start = dt.datetime(2024, 1, 1)
    logs = spark.createDataFrame([("a", i, "L", start + dt.timedelta(days=i), 10 + i) for i in range(20)],
                                 "database string, backup_id long, type string, created timestamp, bytes long")
    chain = spark.createDataFrame([("a", 1, start + dt.timedelta(days=2), start + dt.timedelta(days=16))],
                                  "database string, target_id long, base_ts timestamp, target_ts timestamp")
    got = backup.restore_member_counts(logs, chain).orderBy("span_start").collect()
    assert [(r.span_start, r.logs, r.log_bytes) for r in got] == [(start + dt.timedelta(days=i), 1, 10 + i) for i in range(3, 17)]
