"""Landed telemetry snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..workspace import new_dir
from .schemas import schema_of


def read_telemetry(spark: SparkSession, path: str, view: str | None = None, fmt: str = "parquet",
                   schema: StructType | str | None = None, options: Mapping[str, str] | None = None) -> DataFrame:
    """Snapshots with a fixed schema: nothing is inferred, only the columns used are read."""
    if schema is None and view is not None:
        schema = schema_of(view)
    reader = spark.read.options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


# The column a reader puts a line it cannot read into.
CORRUPT = "_corrupt_record"


def read_quarantined(spark: SparkSession, path: str, view: str | None = None, fmt: str = "json", schema: StructType | str | None = None,
                     options: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Snapshots of text files as (good rows, bad rows), split in one scan.

    A line that does not parse, or whose values do not fit the schema, is a bad
    row (path, record): the file it stands in and the line as it is. Good rows
    have the columns of the schema. Both are landed in the shared folder, side
    by side, as one write.
    """
    columns = (spark.createDataFrame([], schema) if isinstance(schema, str) else spark.createDataFrame([], schema or schema_of(view))).schema
    read = spark.read.options(**(options or {})).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(
        StructType([*columns.fields, StructField(CORRUPT, StringType())])).format(fmt).load(path)
    root, bad = new_dir(spark, "quarantine"), F.col(CORRUPT).isNotNull()
    read.select("*", F.when(bad, F.col("_metadata.file_path")).alias("_path"), bad.alias("_bad")).write.partitionBy("_bad").parquet(root)
    landed = spark.read.schema(StructType([*columns.fields, StructField(CORRUPT, StringType()), StructField("_path", StringType()),
                                           StructField("_bad", BooleanType())])).parquet(root)
    return landed.filter("not _bad").select(*[F.col(f"`{name}`") for name in columns.names]), landed.filter("_bad").select(
        F.col("_path").alias("path"), F.col(CORRUPT).alias("record"))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int, partitions: int,
              options: Mapping[str, str] | None = None) -> DataFrame:
    """Direct pull in parallel ranges of a numeric column; filters are pushed to the server."""
    return (
        spark.read.format("jdbc").options(**(options or {}))
        .option("url", url).option("dbtable", table).option("partitionColumn", column)
        .option("lowerBound", lower).option("upperBound", upper).option("numPartitions", partitions).load()
    )
