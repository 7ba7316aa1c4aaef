"""Text: snippets, names, globs, packed strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from .columns import as_col


def snippet(col: Column | str, n: int, ellipsis: bool = False) -> Column:
    """First ``n`` characters, with ``...`` behind when asked for."""
    head = F.left(as_col(col), F.lit(n))
    return F.concat(head, F.lit("...")) if ellipsis else head


def qualified_name(*cols: Column | str) -> Column:
    """Dotted name; NULL as soon as one part is NULL."""
    parts: list[Column] = []
    for i, col in enumerate(cols):
        parts += [F.lit("."), as_col(col)] if i else [as_col(col)]
    return F.concat(*parts)


def glob_regex(pattern: str) -> str:
    """Anchored regular expression for a comma list of ``*`` / ``?`` globs."""
    def one(glob: str) -> str:
        return "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in glob.strip())
    return "^(?:" + "|".join(one(g) for g in pattern.split(",")) + ")$"


def match_glob(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """Rows whose name matches one of the globs."""
    return df.filter(F.col(col).rlike(glob_regex(pattern)))


def key_prefix(key: Column | str) -> Column:
    """Part of a key before its first ``:`` and then its first ``_``; else ``simple``."""
    key = as_col(key)
    head = F.split_part(F.split_part(key, F.lit(":"), F.lit(1)), F.lit("_"), F.lit(1))
    return F.when(key.contains(":") | key.contains("_"), head).otherwise(F.lit("simple"))


def packed_numbers(col: Column | str) -> Column:
    """``k=1,k2=2`` to a map of whole numbers."""
    pairs = F.str_to_map(as_col(col), F.lit(","), F.lit("="))
    return F.transform_values(pairs, lambda _, value: value.cast("long"))


def joined_args(col: Column | str) -> Column:
    """Command words of a log entry as one line."""
    return F.array_join(as_col(col), " ")


def strip_affixes(col: Column | str, prefix: str = "", suffix: str = "") -> Column:
    """Name without a literal prefix and suffix, where they are present."""
    out = as_col(col)
    if prefix:
        out = F.regexp_replace(out, "^" + re.escape(prefix), "")
    if suffix:
        out = F.regexp_replace(out, re.escape(suffix) + "$", "")
    return out
