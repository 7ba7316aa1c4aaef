"""Foreign keys, uniqueness, missing values, table profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import names


@dataclass(frozen=True)
class ForeignKey:
    """``child`` columns that must appear in ``parent`` columns."""

    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.child_cols)})->{self.parent}({','.join(self.parent_cols)})"


def fk_check(child: DataFrame, parent: DataFrame, child_cols: Sequence[str], parent_cols: Sequence[str]) -> DataFrame:
    """Missing parent keys with the number of child rows; a NULL key part passes.

    The child is reduced to its distinct keys before the join, so a key that
    holds a third of all rows crosses the network once per map task.
    """
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in child_cols])
    keys = child.filter(present).groupBy(*child_cols).agg(F.count("*").alias("rows"))
    wanted = parent.select(*[F.col(p).alias(c) for c, p in zip(child_cols, parent_cols)])
    return keys.join(wanted, list(child_cols), "left_anti")


def fk_violations(child: DataFrame, parent: DataFrame, child_cols: Sequence[str],
                  parent_cols: Sequence[str]) -> DataFrame:
    """The child rows themselves."""
    missing = fk_check(child, parent, child_cols, parent_cols).select(*child_cols)
    return child.join(missing, list(child_cols), "left_semi")


def fk_check_all(tables: Mapping[str, DataFrame], constraints: Sequence[ForeignKey], samples: int = 5) -> DataFrame:
    """Per constraint: violating rows and keys, and the first few missing keys as JSON in one text.

    Every table is read once and no table is joined: see ``_key_stream``. Each
    map task of the second shuffle sends sums, and at most ``samples`` keys a
    constraint.
    """
    checks = [_Check("foreign_key", fk.name, fk.child, fk.child_cols, fk) for fk in constraints]
    stream, shapes = _key_stream(tables, checks)
    missing = stream.filter("rows > 0 and parents = 0").drop("parents")
    lanes = [c for c in missing.columns if c not in ("check", "rows")]
    first = missing.withColumn("place", F.row_number().over(Window.partitionBy("check").orderBy(*lanes))).filter(F.col("place") <= samples)
    shown = F.coalesce(*[F.when(F.col("check") == i, shape.json(check.cols)) for i, (check, shape) in enumerate(zip(checks, shapes))])
    parts = missing.select("check", "rows", F.lit(1).cast("long").alias("keys")).unionByName(
        first.select("check", F.struct("place", shown.alias("key")).alias("sample")), allowMissingColumns=True).unionByName(
        _numbers(stream.sparkSession, len(checks)), allowMissingColumns=True)
    texts = F.transform(F.sort_array(F.collect_list("sample")), lambda sample: sample["key"])
    return parts.groupBy("check").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("violating_rows"), F.coalesce(F.sum("keys"), F.lit(0)).alias("violating_keys"),
        F.array_join(texts, ";").alias("sample_keys"),
    ).select(_named(checks, "subject").alias("constraint"), "violating_rows", "violating_keys", "sample_keys")


@dataclass(frozen=True)
class _Check:
    """One thing to check about ``cols`` of ``table``."""

    kind: str
    subject: str
    table: str
    cols: tuple[str, ...]
    fk: ForeignKey | None = None


@dataclass(frozen=True)
class _Shape:
    """The types of a key, and the lanes its parts travel in: i for whole numbers and instants, f for fractions, s for texts.

    Lanes give keys of all constraints common columns in which equal keys are
    equal and keys sort as their types do.
    """

    types: tuple[T.DataType, ...]

    def lanes(self, cols: Sequence[str]) -> dict[str, Column]:
        return {f"{lane}{i}": col for i, (name, kind) in enumerate(zip(cols, self.types))
                for lane, col in _lanes(F.col(f"`{name}`").cast(kind), kind).items()}

    def json(self, cols: Sequence[str]) -> Column:
        return F.to_json(F.struct(*[_from_lanes(i, kind).alias(name) for i, (name, kind) in enumerate(zip(cols, self.types))]))


def _lanes(col: Column, kind: T.DataType) -> dict[str, Column]:
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return {"i": col.cast("long")}
    if isinstance(kind, T.DateType):
        return {"i": F.unix_date(col).cast("long")}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return {"i": F.unix_micros(col.cast("timestamp"))}
    if isinstance(kind, T.FractionalType):
        # A decimal sorts by its value and is told apart by its digits.
        return {"f": col.cast("double")} | ({"s": col.cast("string")} if isinstance(kind, T.DecimalType) else {})
    return {"s": F.hex(col) if isinstance(kind, T.BinaryType) else col.cast("string")}


def _from_lanes(i: int, kind: T.DataType) -> Column:
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(F.col(f"i{i}").cast("int"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.timestamp_micros(F.col(f"i{i}")).cast(kind)
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.col(f"s{i}"))
    lane = "i" if isinstance(kind, (T.IntegralType, T.BooleanType)) else "f" if isinstance(kind, (T.FloatType, T.DoubleType)) else "s"
    return F.col(f"{lane}{i}").cast(kind)


def _key_stream(tables: Mapping[str, DataFrame], checks: Sequence[_Check]) -> tuple[DataFrame, list[_Shape]]:
    """Rows (check, lanes, rows, parents) per key of each check, and the shapes of the keys.

    Every row of a table goes through one scan and yields its keys, each tagged
    with the check and the side it stands on. One aggregate over all of them,
    combined before its shuffle, tells how many rows a key has and whether it
    has a parent; a key that holds a third of all rows is one row a map task. A
    NULL part of a foreign key passes. A missing value is a key without parts.
    """
    shapes = []
    for check in checks:
        own = tables[check.table].select(*[F.col(f"`{c}`") for c in check.cols])
        both = own.union(tables[check.fk.parent].select(*[F.col(f"`{c}`") for c in check.fk.parent_cols])) if check.fk else own
        shapes.append(_Shape(tuple(field.dataType for field in both.schema.fields) if check.kind != "not_null" else ()))
    used = sorted({(name, str(col_type)) for shape in shapes for name, col_type in _lane_types(shape)})

    def tagged(number: int, cols: Sequence[str], parent: bool, when: Column) -> Column:
        lanes = shapes[number].lanes(cols)
        return F.when(when, F.struct(
            F.lit(number).alias("check"), *[lanes.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in used],
            F.lit(int(not parent)).cast("long").alias("rows"), F.lit(int(parent)).cast("long").alias("parents")))

    found: dict[str, list[Column]] = {}
    for number, check in enumerate(checks):
        every = reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in check.cols])
        when = {"foreign_key": every, "unique": F.lit(True), "not_null": ~every}[check.kind]
        found.setdefault(check.table, []).append(tagged(number, check.cols, False, when))
        if check.fk:
            found.setdefault(check.fk.parent, []).append(tagged(number, check.fk.parent_cols, True, F.lit(True)))
    streams = [tables[name].select(F.inline(F.array(*keys))).filter("check is not null") for name, keys in found.items()]
    stream = reduce(DataFrame.unionByName, streams).groupBy("check", *[name for name, _ in used]).agg(
        F.sum("rows").alias("rows"), F.sum("parents").alias("parents"))
    return stream, shapes


def _lane_types(shape: _Shape) -> list[tuple[str, str]]:
    kinds = {"i": "long", "f": "double", "s": "string"}
    return [(f"{lane}{i}", kinds[lane]) for i, kind in enumerate(shape.types) for lane in _lanes(F.lit(None).cast(kind), kind)]


def _numbers(spark: SparkSession, n: int) -> DataFrame:
    """The numbers of all checks, so that one without a finding has a row too."""
    return spark.range(n).select(F.col("id").cast("int").alias("check"))


def _named(checks: Sequence[_Check], field: str) -> Column:
    return F.element_at(F.array(*[F.lit(getattr(check, field)) for check in checks]), F.col("check") + 1)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > 1)


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column with its number of NULLs, from one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return _long(counts, cols, "column", "nulls")


def _long(row: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in cols]
    return row.select(F.inline(F.array(*pairs)))


def integrity_findings(tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey] = (),
                       unique: Mapping[str, Sequence[str]] | None = None,
                       not_null: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per check: kind, subject, number of violations.

    Foreign keys, unique keys and missing values go through one aggregate: every
    table is read once, nothing is joined.
    """
    checks = [_Check("foreign_key", fk.name, fk.child, fk.child_cols, fk) for fk in foreign_keys]
    checks += [_Check("unique", f"{table}({','.join(keys)})", table, tuple(keys)) for table, keys in (unique or {}).items()]
    checks += [_Check("not_null", f"{table}.{col}", table, (col,)) for table, cols in (not_null or {}).items() for col in cols]
    stream, _ = _key_stream(tables, checks)
    kind = _named(checks, "kind")
    found = (F.when(kind == "foreign_key", F.when(F.col("parents") == 0, F.col("rows")))
             .when(kind == "unique", F.when(F.col("rows") > 1, 1)).otherwise(F.col("rows")))
    counted = stream.select("check", found.cast("long").alias("violations")).unionByName(
        _numbers(stream.sparkSession, len(checks)), allowMissingColumns=True)
    return counted.groupBy("check").agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations")).select(
        kind.alias("check"), _named(checks, "subject").alias("subject"), "violations")


# Verdicts.
HEALTHY, ISSUES_FOUND = "HEALTHY", "ISSUES_FOUND"


def integrity_check(tables: Mapping[str, DataFrame], foreign_keys: Sequence[ForeignKey] = (),
                    unique: Mapping[str, Sequence[str]] | None = None,
                    not_null: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Violations per kind of check and the overall verdict, in one row."""
    found = integrity_findings(tables, foreign_keys, unique, not_null)
    kinds = ["foreign_key", "unique", "not_null"]
    return found.agg(
        *[F.sum(F.when(F.col("check") == kind, F.col("violations")).otherwise(0)).alias(f"{kind}_violations")
          for kind in kinds],
        F.when(F.sum("violations") == 0, F.lit(HEALTHY)).otherwise(F.lit(ISSUES_FOUND)).alias("status"),
    )


def profile_table(df: DataFrame, table: str, primary_key: Sequence[str] = (), not_null: Sequence[str] = (),
                  defaults: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: type, flags, rows, NULLs, approximate distinct values; one pass."""
    defaults = defaults or {}
    fields = df.schema.fields
    row = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{f.name}`").isNull()).alias(f"_n{i}") for i, f in enumerate(fields)],
        *[F.approx_count_distinct(F.col(f"`{f.name}`")).alias(f"_d{i}") for i, f in enumerate(fields)],
    )
    columns = [F.struct(
        F.lit(table).alias("table"), F.lit(i).alias("position"), F.lit(f.name).alias("column"),
        F.lit(f.dataType.simpleString()).alias("type"),
        F.lit(f.name in not_null or not f.nullable).alias("not_null"),
        F.lit(defaults.get(f.name)).cast("string").alias("default"),
        F.lit(f.name in primary_key).alias("primary_key"),
        F.col("_rows").alias("row_count"), F.col(f"_n{i}").alias("null_count"),
        F.col(f"_d{i}").alias("approx_distinct"),
    ) for i, f in enumerate(fields)]
    return row.select(F.inline(F.array(*columns)))


def profile_database(tables: Mapping[str, DataFrame], primary_keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Column profiles of several tables."""
    keys = primary_keys or {}
    return reduce(DataFrame.unionByName,
                  [profile_table(df, name, names(keys.get(name))) for name, df in tables.items()])


def database_totals(profiles: DataFrame) -> DataFrame:
    """Number of tables and rows behind a set of column profiles."""
    per_table = profiles.groupBy("table").agg(F.max("row_count").alias("rows"))
    return per_table.agg(F.count("*").alias("total_tables"), F.sum("rows").alias("total_rows"))
