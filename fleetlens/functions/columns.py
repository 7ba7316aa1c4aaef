"""Small helpers shared by the expression modules."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def names(keys: str | Iterable[str] | None) -> list[str]:
    """Normalise a key argument to a list of column names."""
    if keys is None:
        return []
    return [keys] if isinstance(keys, str) else list(keys)


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Replace NULL by a per-column default; a missing column is added."""
    present = set(df.columns)
    return df.withColumns({
        name: F.coalesce(F.col(name), F.lit(value)) if name in present else F.lit(value)
        for name, value in defaults.items()
    })

