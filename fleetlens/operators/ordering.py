"""Sorting, top-n and unions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import bands
from ..functions.columns import names


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Iterable[str] | str | None = None) -> DataFrame:
    """First rows of a stated order, of the whole table or per key; every task keeps only ``n`` rows (of a key)."""
    return latest_n(df, by, order, n) if names(by) else df.orderBy(*order).limit(n)


def order_by_list(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Rows in a custom order of one column."""
    return df.orderBy(bands.rank_in(col, values))


def recent(df: DataFrame, ts: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """Last rows by time."""
    return top_n(df, [F.desc_nulls_last(ts), *[F.desc(c) for c in tie]], n)


def preview(df: DataFrame, n: int) -> DataFrame:
    """Some rows, in no order."""
    return df.limit(n)


def latest_n(df: DataFrame, by: Iterable[str] | str, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows per key; each map task passes on at most ``n`` rows of a key."""
    window = Window.partitionBy(*names(by)).orderBy(*order)
    position = rank or "_position"
    out = df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= n)
    return out if rank else out.drop(position)


def union_tagged(sources: Mapping[str, DataFrame], tag: str = "type") -> DataFrame:
    """Like-shaped sources in one table, each row tagged with its origin."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
