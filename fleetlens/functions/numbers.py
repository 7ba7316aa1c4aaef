"""Ratios, rounding and guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_col


def pct(num: Column | str, den: Column | str, on_zero: str = "null") -> Column:
    """``100 * num / den`` as a double; a zero denominator gives NULL or 0."""
    num, den = as_col(num).cast("double"), as_col(den).cast("double")
    share = F.try_divide(num * 100.0, den)
    if on_zero == "null":
        return share
    if on_zero == "zero":
        return F.when(den == 0, F.lit(0.0)).otherwise(share)
    raise ValueError("on_zero is 'null' or 'zero'")


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as a double, NULL when the denominator is zero."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def share_of(part: Column | str, rest: Column | str) -> Column:
    """Percent that ``part`` has of ``part + rest``; NULL when both are zero."""
    part, rest = as_col(part), as_col(rest)
    return pct(part, part + rest)


def round_to(col: Column | str, digits: int = 2, rule: str = "half_up") -> Column:
    """Round half up, or half to even where the report asks for it."""
    if rule == "half_up":
        return F.round(as_col(col), digits)
    if rule == "half_even":
        return F.bround(as_col(col), digits)
    raise ValueError("rule is 'half_up' or 'half_even'")


def grouped_digits(col: Column | str) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(as_col(col), 0)


def whole_div(num: Column | str, den: int) -> Column:
    """Integer division, as in whole-number success rates."""
    return F.floor(as_col(num) / F.lit(den)).cast("long")
