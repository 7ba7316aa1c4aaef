"""Backup report files: seven CSV layouts in one table."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.sizes import parse_bytes

# Header lines of the seven report files, by kind of system.
LAYOUTS = {
    "influxdb": "Timestamp,Host,Version,Database_Bucket,Status,Size,Duration_sec,BackupPath",
    "db2": "Timestamp,Instance,Database,BackupType,Status,BackupPath,Duration_sec,Size",
    "mysql": "Timestamp,Database,Status,BackupFile,Size,Duration(s),Host",
    "oracle": "Timestamp,Oracle_SID,Backup_Type,Status,Backup_Dir,Duration",
    "postgresql": "Timestamp,Database,Status,BackupFile,Size,Duration",
    "sqlserver": "Timestamp,Server,Database,BackupType,BackupFile,SizeMB,Status,Duration",
    "postgresql_windows": "Timestamp,Database,BackupFile,Size,Status",
}
# Which header names feed which column.
COLUMNS = {
    "server": ["Host", "Instance", "Server"],
    "database": ["Database", "Database_Bucket", "Oracle_SID"],
    "kind": ["BackupType", "Backup_Type"],
    "status": ["Status"],
    "path": ["BackupFile", "BackupPath", "Backup_Dir"],
    "size_text": ["Size", "SizeMB"],
    "duration_text": ["Duration", "Duration_sec", "Duration(s)"],
}
TIMESTAMPS = ["yyyy-MM-dd HH:mm:ss", "M/d/yyyy h:mm:ss a"]


def read_backup_reports(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Reports of several layouts as one table; ``N/A`` and ``Unknown`` become NULL.

    A size without a unit is bytes, except in the layout that reports MB.
    """
    return reduce(DataFrame.unionByName, [_read(spark, layout, path) for layout, path in paths.items()])


def _read(spark: SparkSession, layout: str, path: str) -> DataFrame:
    header = LAYOUTS[layout].split(",")
    schema = ", ".join(f"`{name}` string" for name in header)
    raw = spark.read.schema(schema).csv(path, header=True, enforceSchema=False)

    def field(target: str) -> Column:
        found = [f"`{name}`" for name in COLUMNS[target] if name in header]
        return F.col(found[0]) if found else F.lit(None).cast("string")

    size = F.concat(field("size_text"), F.lit("MB")) if "SizeMB" in header else field("size_text")
    ts = F.coalesce(*[F.try_to_timestamp("Timestamp", F.lit(fmt)) for fmt in TIMESTAMPS])
    return raw.select(
        F.lit(layout).alias("layout"), ts.alias("ts"),
        *[field(name).alias(name) for name in ("server", "database", "kind", "status", "path", "size_text")],
        parse_bytes(size).alias("size_bytes"), field("duration_text").try_cast("double").alias("duration_seconds"),
    )


def append_report(df: DataFrame, path: str, run_id: str) -> None:
    """Append one run's outcome rows; a repeated run replaces its own rows only."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run_id}")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
