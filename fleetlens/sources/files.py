"""Files on disk: inventory and sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

HEAD_BYTES = 64 << 10


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and modification time of every file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def directory_sizes(inventory: DataFrame) -> DataFrame:
    """Files and bytes per directory."""
    return inventory.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(
        F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("modified"))


def inventory_total(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def file_heads(spark: SparkSession, path: str, lines: int = 5, limit: int = HEAD_BYTES) -> DataFrame:
    """Rows (path, bytes, read_bytes, lines): the first lines of every file, of which no more than ``limit`` bytes are read.

    Spark lists the files and shares them out; each task opens its files, reads
    until the lines are there or the limit is reached, and stops. Compressed
    files (by their ending) are unpacked on the way; ``read_bytes`` counts what
    was unpacked. Files are opened through Arrow's file systems; where only
    Spark reaches a store, ``logs.first_lines`` reads them through instead.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [read_head(uri, lines, limit) for uri in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("path"), batch.column("bytes"), pa.array([len(head) for head in heads], pa.int64()),
                pa.array([head.decode(errors="replace").split("\n")[:lines] for head in heads], pa.list_(pa.string()))],
                names=["path", "bytes", "read_bytes", "lines"])
    return file_inventory(spark, path).select("path", "bytes").mapInArrow(run, "path string, bytes long, read_bytes long, lines array<string>")


def read_head(uri: str, lines: int, limit: int, step: int = 4 << 10) -> bytes:
    """The beginning of one file, up to so many line breaks or bytes."""
    store, path = fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    head = b""
    with store.open_input_stream(path, compression="detect", buffer_size=step) as stream:
        while len(head) < limit and head.count(b"\n") < lines:
            more = stream.read(min(step, limit - len(head)))
            if not more:
                break
            head += more
    return head
