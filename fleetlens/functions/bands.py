"""Ordered threshold bands and equality decodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .columns import as_col

_TESTS = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "==": lambda c, v: c == v,
}

Rule = tuple[str, object, object]


def band(col: Column | str, rules: Sequence[Rule], else_label: object, null_label: object = None) -> Column:
    """Label of the first rule ``(test, threshold, label)`` that holds.

    A NULL value takes ``null_label`` when one is given and ``else_label``
    otherwise.
    """
    value = as_col(col)
    branches = [(_TESTS[test](value, F.lit(limit)), label) for test, limit, label in rules]
    if null_label is not None:
        branches.insert(0, (value.isNull(), null_label))
    out = F.when(branches[0][0], F.lit(branches[0][1]))
    for condition, label in branches[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(else_label))


def decode(col: Column | str, labels: Mapping[object, object], else_label: object = None) -> Column:
    """Label by exact value."""
    return band(col, [("==", key, label) for key, label in labels.items()], else_label)


def rank_in(col: Column | str, values: Sequence[object]) -> Column:
    """Position of a value in a custom order; unlisted values come last."""
    return decode(col, {value: i for i, value in enumerate(values)}, len(values))


# Thresholds and labels of the reports.
LAG_DETAIL = [("==", 0, "SYNCHRONIZED"), ("<", 60, "ACCEPTABLE"), ("<", 300, "WARNING")]
LAG_SUMMARY = [("==", 0, "SYNCHRONIZED"), ("<", 60, "ACCEPTABLE_LAG")]
LAG_STOPPED = "REPLICATION_STOPPED"
FRAGMENTATION_ACTION = [(">=", 30.0, "REBUILD"), (">=", 5.0, "REORGANIZE")]
FRAGMENTATION_PRIORITY = [(">=", 30.0, 1), (">=", 5.0, 2)]
FRAGMENTATION_LEVEL = [("<", 5.0, "Good"), ("<", 30.0, "Moderate")]
BACKUP_KINDS = {"D": "Full", "I": "Differential", "L": "Transaction Log"}
