"""Byte sizes as text and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col

# Unit names of the size reports, in steps of 1024.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
IEC_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def format_bytes(col: Column | str, style: str = "plain") -> Column:
    """``1.5 MB`` (plain) or ``1.5MiB`` (iec: rounds up, no decimals from 10 on)."""
    size = as_col(col).cast("double")
    if style == "plain":
        text = F.format_string("%.1f PB", size / F.lit(float(1024 ** 5)))
        for power in range(4, -1, -1):
            scaled = size / F.lit(float(1024 ** power))
            text = F.when(scaled < 1024, F.format_string(f"%.1f {UNITS[power]}", scaled)).otherwise(text)
        return F.when(size.isNotNull(), text)
    if style == "iec":
        text = _iec(size, 5)
        for power in range(4, -1, -1):
            text = F.when(F.ceil(size / F.lit(float(1024 ** power))) < 1024, _iec(size, power)).otherwise(text)
        return F.when(size.isNotNull(), text)
    raise ValueError("style is 'plain' or 'iec'")


def _iec(size: Column, power: int) -> Column:
    unit = IEC_UNITS[power]
    scaled = size / F.lit(float(1024 ** power))
    whole = F.format_string(f"%d{unit}", F.ceil(scaled))
    if power == 0:
        return whole
    tenths = F.ceil(scaled * 10)
    return F.when(tenths < 100, F.format_string(f"%.1f{unit}", tenths / F.lit(10.0))).otherwise(whole)


def parse_bytes(col: Column | str) -> Column:
    """Bytes from ``1.5 MB``, ``1.5MiB``, ``4.0K``, ``12 bytes`` or ``12``; else NULL."""
    text = F.trim(as_col(col))
    shape = r"(?i)^([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)(?:i?B|bytes)?$"
    number = F.regexp_extract(text, shape, 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, shape, 2))
    factor = F.lit(1.0)
    for power, name in enumerate("KMGTP", start=1):
        factor = F.when(unit == name, F.lit(float(1024 ** power))).otherwise(factor)
    return number * factor


def to_mb(col: Column | str) -> Column:
    return as_col(col).cast("double") / F.lit(1048576.0)


def to_gb(col: Column | str) -> Column:
    return as_col(col).cast("double") / F.lit(1073741824.0)
