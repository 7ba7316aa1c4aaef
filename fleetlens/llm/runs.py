"""Runs of equal keys in sorted partitions, and large groups cut into pairs of blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal (integer) keys, one table a run, over the borders of batches."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        values = np.stack([rows.column(k).to_numpy() for k in keys], 1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        if held:
            last = [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in keys]
            if last != values[0].tolist():
                yield pa.concat_tables(held)
                held = []
        starts = [0, *cuts.tolist(), rows.num_rows]
        for a, b in zip(starts[:-2], starts[1:-1]):
            held.append(rows.slice(a, b - a))
            yield pa.concat_tables(held)
            held = []
        held.append(rows.slice(starts[-2]))
    if held:
        yield pa.concat_tables(held)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes, cut only where a key changes. A row counts for 128 bytes more than it has."""
    held: list[pa.Table] = []
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            held.append(pa.Table.from_batches([batch.slice(start, 1024)]))
            if sum(table.nbytes + 128 * table.num_rows for table in held) < size:
                continue
            rows = pa.concat_tables(held)
            values = np.stack([rows.column(key).to_numpy() for key in keys], 1)
            others = np.flatnonzero((values != values[-1]).any(1))
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                yield rows.slice(0, cut)
            held = [rows.slice(cut)]
    if held:
        yield pa.concat_tables(held)


def block_pairs(members: DataFrame, node: str, size: str, block: int) -> DataFrame:
    """Rows of ``members`` for every pair of blocks (lo, hi) their group is cut into; ``own`` is the row's block.

    A group of at most ``block`` rows is one pair of one block. A larger one is
    dealt by a hash into n blocks of about ``block`` rows, and each row goes to
    the n pairs that hold its block, so any two rows meet exactly once.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit("block")), n).cast("int")
    paired = members.withColumn("_n", n).withColumn("own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return paired.withColumn("lo", F.least("own", "_other")).withColumn("hi", F.greatest("own", "_other")).drop("_n", "_other")


def by_runs(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows of a key side by side in one partition."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def may_meet(own: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Which pairs of rows belong to this pair of blocks: upper triangle, or only across the two blocks."""
    upper = np.triu(np.ones((len(own), len(own)), bool), 1)
    return upper if lo == hi else upper & (own[:, None] != own[None, :])
