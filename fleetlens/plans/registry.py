"""Registration of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..session import tune

ORDERS_AS_OF = "2001-08-01 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"


class Tables:
    """Lazy access to the parquet tables of one directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = tune(spark)
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def _table(name: str) -> cached_property:
    prop = cached_property(lambda self: self.read(name))
    prop.__set_name__(Tables, name)
    return prop


TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
for _name in TABLE_NAMES:
    setattr(Tables, _name, _table(_name))

Plan = Callable[[Tables], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a query, with its SQL check where SQL can express it."""
    def register(fn: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return register


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: PLANS[name](Tables(spark, sf_dir))
