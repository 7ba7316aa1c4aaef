"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import aggregates, filters, ordering, rules
from fleetlens.plans.registry import ORACLES

SF_DIR = "/root/testdata/sf0.001"
STREAMS = {name for name in entry.queries() if name.startswith("s0")}
CORPUS = set(entry.corpus_queries())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - STREAMS - CORPUS))
def test_no_python_and_no_cross_products(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for bad in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, name


def test_top_n_never_sorts_everything(spark):
    plan = plan_of(ordering.top_n(spark.range(100).toDF("id"), [F.desc("id")], 5))
    assert "TakeOrderedAndProject" in plan


def test_latest_n_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = plan_of(ordering.latest_n(df, ["k"], [F.desc("id")], 2))
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


@pytest.mark.parametrize("build", [
    lambda t: aggregates.metric_rows(t, {"a": F.col("l_orderkey"), "b": F.col("l_partkey"), "c": F.col("l_suppkey")}),
    lambda t: filters.describe_metrics(t.select(F.col("l_returnflag").alias("name")), {"A": "x", "R": "y"}),
    lambda t: rules.config_assessment(t.select(F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("value"))),
])
def test_one_scan(spark, build):
    table = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    assert plan_of(build(table)).count("FileScan") == 1


def test_only_needed_columns_are_read(spark):
    table = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    plan = plan_of(aggregates.count_by(table, "l_returnflag"))
    assert re.search(r"ReadSchema: struct<l_returnflag:string>", plan)


def test_filters_reach_the_scan(spark):
    plan = plan_of(entry.queries()["a01_read_telemetry"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan


@pytest.mark.parametrize("name,column", [
    ("b02_long_running", "o_orderdate"), ("d11_hourly_metrics", "ts"), ("k14_maintenance_history", "l_shipdate"),
    ("e04_long_term_retention", "o_orderdate")])
def test_time_limits_reach_the_scan(spark, name, column):
    pushed = re.findall(r"PushedFilters: \[(.*?)\]", plan_of(entry.queries()[name](spark, SF_DIR)))
    assert any(re.search(rf"Than(OrEqual)?\({column},", filters) for filters in pushed), pushed


def test_no_broadcast_is_forced_on_growing_data(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("b12_elapsed", "c02_lock_waiters", "c03_resolve_objects", "c07_fk_check", "c09_index_usage",
                     "k03_retention_audit", "k08_table_diff", "k09_apply_changes", "k16_enforce_series_retention"):
            assert "BroadcastHashJoin" not in plan_of(entry.queries()[name](spark, SF_DIR)), name
        # Ordered scans broadcast their busiest keys and where these are cut, a bounded number: see MAX_CHUNKS.
        assert plan_of(entry.queries()["e03_counter_rate"](spark, SF_DIR)).count("BroadcastHashJoin") <= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checks_read_whole_tables():
    for name, sql in ORACLES.items():
        assert "USING SAMPLE" not in sql and "TABLESAMPLE" not in sql, name
