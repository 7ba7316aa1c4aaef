"""Writers and readers of table exports."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from ..functions.numbers import ratio
from ..operators.movement import fingerprint_columns
from ..workspace import observed, side_by_side
from .files import file_inventory, inventory_total

# How files spell instants, to the microsecond.
TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# How CSV exports spell values, so that a round trip loses nothing.
CSV_OPTIONS = {
    "header": "true", "nullValue": "\\N", "emptyValue": '""', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", **TIME_OPTIONS,
}
# The backslash is among them so that no text looks like the NULL mark.
CSV_ESCAPES = [("%", "%25"), ("\n", "%0A"), ("\r", "%0D"), ("\\", "%5C")]
MANIFEST_SCHEMA = (
    "backup_name string, `table` string, rows long, checksum_xor long, checksum_sum string, "
    "schema_json string, format string, error string, started_at timestamp, completed_at timestamp"
)


def write_report_json(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines, instants to the microsecond."""
    df.write.mode("overwrite").options(**TIME_OPTIONS).json(path)


def write_report_csv(df: DataFrame, path: str) -> None:
    """Report as CSV with a header, one line per row; spelt as :func:`write_table` does, so :func:`read_table` reads it."""
    write_table(df, path)


def export_ndjson(df: DataFrame, path: str, compression: str = "gzip") -> DataFrame:
    """Write a collection as one JSON document per line; returns its statistics, counted on the way."""
    seen = Observation()
    counted = df.observe(seen, F.count("*").alias("documents"))
    counted.write.mode("overwrite").options(**TIME_OPTIONS).json(path, compression=compression)
    spark = df.sparkSession
    size = inventory_total(file_inventory(spark, path))
    documents = observed(seen).get("documents", 0)
    return size.select(F.lit(documents).cast("long").alias("documents"), "files", "bytes",
                       ratio("bytes", F.lit(documents)).alias("avg_document_bytes"))


def _nested(field) -> bool:
    return isinstance(field.dataType, (ArrayType, MapType, StructType))


def _to_csv_row(df: DataFrame) -> DataFrame:
    """Columns as CSV can hold them: nested values as JSON, binary as base64, one line per row, so that files split."""
    def spell(field) -> Column:
        col = F.col(f"`{field.name}`")
        if _nested(field):
            col = F.to_json(F.struct(col.alias("v")), TIME_OPTIONS)
        elif isinstance(field.dataType, BinaryType):
            col = F.base64(col)
        elif not isinstance(field.dataType, StringType):
            return col
        for raw, code in CSV_ESCAPES:
            col = F.replace(col, F.lit(raw), F.lit(code))
        return col.alias(field.name)
    return df.select(*[spell(f) for f in df.schema.fields])


def _from_csv_row(df: DataFrame, schema: StructType) -> DataFrame:
    def read(field) -> Column:
        col = F.col(f"`{field.name}`")
        textual = _nested(field) or isinstance(field.dataType, (StringType, BinaryType))
        if not textual:
            return col
        for raw, code in reversed(CSV_ESCAPES):
            col = F.replace(col, F.lit(code), F.lit(raw))
        if _nested(field):
            col = F.from_json(col, StructType().add("v", field.dataType), TIME_OPTIONS).getField("v")
        elif isinstance(field.dataType, BinaryType):
            col = F.unbase64(col)
        return col.alias(field.name)
    return df.select(*[read(f) for f in schema.fields])


def _csv_schema(schema: StructType) -> StructType:
    flat = StructType()
    for field in schema.fields:
        text = _nested(field) or isinstance(field.dataType, BinaryType)
        flat.add(field.name, StringType() if text else field.dataType)
    return flat


def write_table(df: DataFrame, path: str, fmt: str = "csv", compression: str | None = None) -> None:
    """One table as CSV or in a columnar format."""
    options = {"compression": compression} if compression else {}
    if fmt == "csv":
        _to_csv_row(df).write.mode("overwrite").options(**CSV_OPTIONS, **options).csv(path)
    else:
        df.write.mode("overwrite").options(**options).format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """A table as it was written by :func:`write_table`."""
    if fmt == "csv":
        raw = spark.read.schema(_csv_schema(schema)).options(**{**CSV_OPTIONS, "emptyValue": ""}).csv(path)
        return _from_csv_row(raw, schema)
    return spark.read.schema(schema).format(fmt).load(path)


@dataclass
class TableResult:
    """What happened to one table of an export."""

    table: str
    rows: int
    checksum_xor: int | None
    checksum_sum: str | None
    schema_json: str
    started_at: datetime
    completed_at: datetime
    error: str | None = None


def _export_one(df: DataFrame, name: str, path: str, fmt: str, include_data: bool, parallelism: int | None) -> TableResult:
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    rows, xor, total, error = 0, None, None, None
    try:
        if include_data and not df.isEmpty():
            seen = Observation()
            data = df.observe(seen, *fingerprint_columns(df))
            write_table(data if parallelism is None else data.repartition(parallelism), f"{path}/data/{name}", fmt)
            rows, xor, total = seen.get["rows"], seen.get["checksum_xor"], str(seen.get["checksum_sum"])
    except Exception as problem:  # one bad table must not stop the others
        error = f"Failed to backup table {name}: {problem}"
    done = datetime.now(timezone.utc).replace(tzinfo=None)
    return TableResult(name, rows, xor, total, df.schema.json(), started, done, error)


def export_database(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, backup_name: str, fmt: str = "csv",
                    include_data: bool = True, parallelism: int | None = None, jobs: int = 4) -> DataFrame:
    """Write data, schemas and a manifest of several tables; empty tables get a schema only.

    Rows and checksum of every table are counted while it is written, so the
    source is read once; ``jobs`` tables are written at a time, each into
    ``parallelism`` files. Returns the manifest, one row per table.
    """
    results = side_by_side(
        [lambda df=df, name=name: _export_one(df, name, path, fmt, include_data, parallelism)
         for name, df in tables.items()], jobs)
    export_schema(spark, tables).write.mode("overwrite").json(f"{path}/schema")
    rows = [(backup_name, r.table, r.rows, r.checksum_xor, r.checksum_sum, r.schema_json, fmt, r.error,
             r.started_at, r.completed_at) for r in results]
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest of an export; a missing one is an error."""
    return spark.read.schema(MANIFEST_SCHEMA).json(f"{path}/manifest")


def export_schema(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Schema of each table as JSON and as a CREATE TABLE statement."""
    return spark.createDataFrame(
        [(name, df.schema.json(), create_statement(df, name)) for name, df in tables.items()],
        "`table` string, schema_json string, ddl string")


def create_statement(df: DataFrame, table: str) -> str:
    """CREATE TABLE as Spark reads it."""
    def quoted(name: str) -> str:
        return "`" + name.replace("`", "``") + "`"
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema.fields)
    return f"CREATE TABLE {quoted(table)} ({columns});"


def read_schemas(spark: SparkSession, path: str) -> dict[str, StructType]:
    """Schemas by table of an export's schema file, which has one row per table."""
    rows = spark.read.schema("`table` string, schema_json string").json(f"{path}/schema").collect()
    return {row["table"]: StructType.fromJson(json.loads(row["schema_json"])) for row in rows}


def restore_database(spark: SparkSession, path: str, only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Tables of an export by name, read with the schemas of its manifest.

    The manifest has one row per table; that is all the driver reads.
    """
    restored = {}
    for row in read_manifest(spark, path).filter(F.col("error").isNull()).collect():
        if only is not None and row["table"] not in only:
            continue
        schema = StructType.fromJson(json.loads(row["schema_json"]))
        if row["rows"] == 0:
            restored[row["table"]] = spark.createDataFrame([], schema)
        else:
            restored[row["table"]] = read_table(spark, f"{path}/data/{row['table']}", schema, row["format"])
    return restored


def restore_into(spark: SparkSession, path: str, database: str, location: str | None = None) -> None:
    """Restore an export as managed tables of a database, under its own or another name.

    A database that is not there is made, in the folder ``location`` or the warehouse.
    """
    where = "" if location is None else " LOCATION '{}'".format(location.replace("'", "\\'"))
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`{where}")
    side_by_side([lambda df=df, name=name: df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
                  for name, df in restore_database(spark, path).items()])


# The types of a dump, in standard SQL; what is not listed is text.
DUMP_TYPES = {
    "boolean": "BOOLEAN", "tinyint": "SMALLINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT",
    "float": "REAL", "double": "DOUBLE PRECISION", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP", "binary": "BLOB",
}


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _quoted(col: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(col, F.lit("'"), F.lit("''")), F.lit("'"))


def sql_literal(col: Column, kind: str) -> Column:
    """A value as it stands in an INSERT statement: binary in hex, nested values as JSON text, NaN and infinities quoted."""
    if kind.startswith(("array<", "map<", "struct<")):
        # Packed, as a list of lists or a map is no row; what packs it is cut off again.
        inner = F.to_json(F.struct(col.alias("v")), {**TIME_OPTIONS, "ignoreNullFields": "false"})
        text = _quoted(F.substring(inner, F.lit(6), F.length(inner) - 6))
    elif kind == "binary":
        text = F.concat(F.lit("X'"), F.hex(col), F.lit("'"))
    elif kind in ("double", "float"):
        finite = ~F.isnan(col) & (F.abs(col) != float("inf"))
        text = F.when(finite, col.cast("string")).otherwise(_quoted(col.cast("string")))
    elif kind in DUMP_TYPES and kind not in ("timestamp", "timestamp_ntz", "date") or kind.startswith("decimal"):
        text = col.cast("string")
    else:
        text = _quoted(col.cast("string"))
    return F.when(col.isNull(), F.lit("NULL")).otherwise(text)


def dump_statement(df: DataFrame, table: str) -> str:
    """CREATE TABLE of a dump, in the same dialect as its INSERT statements."""
    columns = ", ".join(
        f"{_name(name)} {kind.upper() if kind.startswith('decimal') else DUMP_TYPES.get(kind, 'TEXT')}" for name, kind in df.dtypes)
    return f"CREATE TABLE {_name(table)} ({columns});"


def insert_statements(df: DataFrame, table: str) -> DataFrame:
    """One INSERT statement per row."""
    parts: list[Column] = [F.lit(f"INSERT INTO {_name(table)} VALUES(")]
    for i, field in enumerate(df.schema.fields):
        name = field.name.replace("`", "``")
        parts += [F.lit(",")] if i else []
        parts.append(sql_literal(F.col(f"`{name}`"), field.dataType.simpleString()))
    return df.select(F.concat(*parts, F.lit(");")).alias("value"))


def export_sql_dump(df: DataFrame, table: str, path: str, header: str = "-- Database Export") -> None:
    """Logical dump: header and DDL, then the data as INSERT statements, in standard SQL throughout.

    Line breaks inside values stay as they are: a statement may span lines.
    Instants are in the session's time zone, UTC after ``tune``.
    """
    head = df.sparkSession.range(1).select(F.lit(f"{header}\n{dump_statement(df, table)}").alias("value"))
    head.coalesce(1).write.mode("overwrite").text(f"{path}/ddl")
    insert_statements(df, table).write.mode("overwrite").text(f"{path}/data")


def compression_report(spark: SparkSession, plain: str, packed: str) -> DataFrame:
    """Bytes before and after compression, and their ratio."""
    sizes = inventory_total(file_inventory(spark, plain)).select(F.col("bytes").alias("original_bytes")).unionByName(
        inventory_total(file_inventory(spark, packed)).select(F.col("bytes").alias("compressed_bytes")),
        allowMissingColumns=True)
    return sizes.agg(*[F.max(c).alias(c) for c in ("original_bytes", "compressed_bytes")]).withColumn(
        "ratio", ratio("compressed_bytes", "original_bytes"))


def write_compressed(df: DataFrame, plain: str, packed: str, codec: str = "gzip") -> DataFrame:
    """Write rows as JSON lines twice, plain and compressed, and compare."""
    df.write.mode("overwrite").json(plain)
    df.write.mode("overwrite").json(packed, compression=codec)
    return compression_report(df.sparkSession, plain, packed)
