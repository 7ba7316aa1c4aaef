"""Pieces several operators share: row selection, landed tables, connected groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..workspace import new_dir, passing_dirs, remove_dir


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """Only the columns an operator reads, so that no other column can clash; a NULL text is empty."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def remainder(doc_id: str | Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a NULL id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def land(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once and outlives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    # Most of it is text or numbers that repeat, read once or twice: small files count for more than fast ones.
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def land_last(make: Callable[[], DataFrame], spark: SparkSession, label: str) -> DataFrame:
    """``land`` what ``make`` returns, and remove the tables that were landed to get it."""
    with passing_dirs() as passed:
        out = land(make(), label)
    for path in passed[:-1]:
        remove_dir(spark, path)
    return out


def small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """Broadcast a landed table of a few short columns if it has at most ``rows`` rows; else leave the join to shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def pieces(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with about ``limit`` bytes each, to bound a task's memory.

    What earlier batches took is handed back, as workers live on between tasks.
    """
    for batch in batches:
        pa.default_memory_pool().release_unused()
        start, size, step = 0, 0, max(1, batch.num_rows and batch.nbytes // batch.num_rows)
        rows = max(1, limit // step)
        if batch.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        lengths = _text_lengths(batch)
        if lengths is None:
            for start in range(0, batch.num_rows, rows):
                yield batch.slice(start, rows)
            continue
        start, size = 0, 0
        for row, length in enumerate(lengths):
            if size and size + length > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += length
        if start < batch.num_rows:
            yield batch.slice(start)


def _text_lengths(batch: pa.RecordBatch) -> list[int] | None:
    if "text" not in batch.schema.names:
        return None
    import pyarrow.compute as pc
    return [n or 0 for n in pc.binary_length(batch.column("text")).to_pylist()]


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def components(edges: DataFrame, label: str = "groups") -> DataFrame:
    """Smallest member of each connected group: rows (node, root) for every node of ``edges`` (a, b).

    Every round takes the smallest label among a node and its neighbours, then
    the label of that label, so long chains shrink by more than half a round.
    Each round is one table in the shared folder; only a count reaches the
    driver. Edges with a NULL end are ignored.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).filter("node is not null and near is not null")
    both = land(both.union(both.select(F.col("near"), F.col("node"))).distinct(), f"{label}-edges")
    labels = land(both.groupBy("node").agg(F.min("near").alias("near"))
                  .select("node", F.least("node", "near").alias("root")), f"{label}-0")
    number = 0
    while True:
        number += 1
        offered = both.join(labels.select(F.col("node").alias("near"), "root"), "near").groupBy("node").agg(
            F.min("root").alias("offered"))
        closer = labels.join(offered, "node").select("node", F.least("root", "offered").alias("next"), F.col("root").alias("was"))
        roots = labels.select(F.col("node").alias("next"), F.col("root").alias("beyond"))
        step = closer.join(roots, "next", "left").select(
            "node", F.least("next", F.coalesce("beyond", "next")).alias("root"), "was")
        step = land(step, f"{label}-{number}")
        labels = step.select("node", "root")
        if step.filter("root <> was").isEmpty():
            return labels
