"""Constraints of all tables in one aggregation."""

from __future__ import annotations

import datetime as dt
import decimal
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.operators import integrity
from fleetlens.operators.integrity import ForeignKey

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("child_type, parent_type, present, missing, shown", [
    ("int", "long", [1, 2], [9, 10, 100], ["9", "10", "100"]),
    ("string", "string", ["a"], ["b;,", "c\u0001"], ['"b;,"', '"c\\u0001"']),
    ("decimal(10,2)", "decimal(12,4)", [decimal.Decimal("1.50")], [decimal.Decimal("10.25"), decimal.Decimal("9.75")], ["9.7500", "10.2500"]),
    ("date", "date", [dt.date(2024, 1, 1)], [dt.date(2023, 5, 6), dt.date(1969, 1, 2)], ['"1969-01-02"', '"2023-05-06"']),
    ("timestamp", "timestamp", [dt.datetime(2024, 1, 1)], [dt.datetime(2024, 1, 1, 0, 0, 1)], ['"2024-01-01T00:00:01.000Z"']),
    ("double", "float", [0.5, 0.0], [10.5, 2.5], ["2.5", "10.5"]),
    ("boolean", "boolean", [True], [False], ["false"]),
])
def test_missing_keys_of_any_type(spark, child_type, parent_type, present, missing, shown):
    child = spark.createDataFrame([(v,) for v in present + missing * 2 + [None]], f"`odd name` {child_type}")
    parent = spark.createDataFrame([(v,) for v in present + present + [None]], f"pk {parent_type}")
    key = ForeignKey("child", ("odd name",), "parent", ("pk",))
    row = integrity.fk_check_all({"child": child, "parent": parent}, [key]).first()
    assert (row.violating_rows, row.violating_keys) == (2 * len(missing), len(missing))
    assert row.sample_keys == ";".join(f'{{"odd name":{text}}}' for text in shown)


def test_keys_of_several_parts_and_shapes(spark):
    child = spark.createDataFrame([(1, "x", 5), (1, "y", 5), (None, "y", 6), (2, None, 7), (2, "x", 7)], "a int, b string, c int")
    parent = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    single = spark.createDataFrame([(5,), (5,)], "c int")
    keys = [ForeignKey("child", ("a", "b"), "parent", ("a", "b")), ForeignKey("child", ("c",), "single", ("c",)),
            ForeignKey("child", ("a",), "child", ("c",))]
    rows = integrity.fk_check_all({"child": child, "parent": parent, "single": single}, keys, samples=1).collect()
    assert {r.constraint: (r.violating_rows, r.violating_keys, r.sample_keys) for r in rows} == {
        "child(a,b)->parent(a,b)": (2, 2, '{"a":1,"b":"y"}'), "child(c)->single(c)": (3, 2, '{"c":6}'), "child(a)->child(c)": (4, 2, '{"a":1}')}


def test_findings(spark):
    child = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (None, "x"), (3, None)], "a int, b string")
    empty = spark.createDataFrame([], "a int")
    found = integrity.integrity_findings({"child": child, "empty": empty}, [ForeignKey("child", ("a",), "empty", ("a",))],
                                         {"child": ["a", "b"], "empty": ["a"]}, {"child": ["a", "b"], "empty": ["a"]}).collect()
    assert {(r.check, r.subject): r.violations for r in found} == {
        ("foreign_key", "child(a)->empty(a)"): 3, ("unique", "child(a,b)"): 2, ("unique", "empty(a)"): 0,
        ("not_null", "child.a"): 2, ("not_null", "child.b"): 1, ("not_null", "empty.a"): 0}


def test_one_key_with_most_rows(spark):
    child = spark.range(100_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("k"))
    parent = spark.range(0, 100_000, 6).toDF("k")
    row = integrity.fk_check_all({"c": child, "p": parent}, [ForeignKey("c", ("k",), "p", ("k",))]).first()
    assert (row.violating_rows, row.violating_keys) == (66_666 + 16_667, 16_667 + 1)


@pytest.mark.parametrize("name, tables", [("c07_fk_check_all", 5), ("k17_integrity_check", 3), ("k17_integrity_clean", 7)])
def test_each_table_is_read_once(spark, name, tables):
    df = entry.queries()[name](spark, SF_DIR)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == tables
    assert len(re.findall(r"- Exchange ", plan)) <= 3 and "Join" not in plan
