"""Filter interaction audit: what each filter removes, loses and duplicates at every place of every order.

Each document is reduced to the set of filters it fails. Orders are numbered
lexicographically by their Lehmer code, so all orders that begin alike are one
interval of numbers. A set of failures is removed at step k by filter f in the
orders that begin with k - 1 filters it passes, then f: a few whole intervals.
Counts are added where an interval begins and taken off where it ends, and
prefix sums over the numbers give the removals of every order at once; no order
is ever replayed, and documents are read once however many orders there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import land, pieces, texts

CHUNK_BYTES = 2 << 20

# The filters by their letters.
FILTERS = "ABCDE"
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#$%&*|"


def text_failures(docs: DataFrame, *more: str | Column, min_words: int = 50, min_distinct: int = 65, max_upper: int = 5) -> DataFrame:
    """Rows (doc_id, digest, mask) and the columns ``more``: what a text fails by itself, in one pass without a shuffle.

    Bits of ``mask`` from the lowest: under ``min_words`` words, fewer than
    ``min_distinct`` per cent of them distinct, more than ``max_upper`` per cent
    capitals, any symbol. ``digest`` is the text's SHA-256.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, CHUNK_BYTES):
            masks, digests = [], []
            for text in batch.column("text").to_pylist():
                # Without arguments, bytes are split at ASCII white space alone.
                words = text.split()
                few = len(words) < min_words
                alike = 100 * len(set(words)) < min_distinct * len(words)
                upper = len(text) - len(text.translate(None, _UPPER))
                loud = 100 * upper > max_upper * len(text.translate(None, _CONTINUED))
                marked = len(text.translate(None, _SYMBOLS)) < len(text)
                masks.append(few | alike << 1 | loud << 2 | marked << 3)
                digests.append(hashlib.sha256(text).digest())
            kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=[*names, "digest", "mask"])
    read = texts(docs, *more).withColumn("text", F.col("text").cast("binary"))
    kinds = ", ".join(f"`{name}` {kind}" for name, kind in read.dtypes if name != "text")
    return read.mapInArrow(run, f"{kinds}, digest binary, mask int")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (part, mask, documents, good, toxic) of documents by source and the set of filters they fail.

    The last bit is for texts equal to that of a smaller id. The smallest id of a
    text is a minimum combined on the map side, and a row looks it up by text and
    its own id, so a text that a third of all rows share gathers nowhere.

    A NULL source is the part "". A NULL text is empty. A NULL id has no label,
    is no copy and makes none. Rows that repeat an id are documents of their own.
    Labels that repeat an id hold if any of its rows says so; a NULL label says
    nothing.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = land(text_failures(docs, source), "audit-failures")
    first = rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = rows.join(first, ["doc_id", "digest"], "left").join(said, "doc_id", "left")
    copied = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return known.groupBy("part", F.col("mask").bitwiseOR(F.when(copied, 16).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def removal_intervals(mask: int, n: int) -> list[tuple[int, int, int]]:
    """(step, begin, end) of the order numbers at which a set of failed filters is removed at that step.

    Neighbouring intervals of one step are joined.
    """
    found: list[tuple[int, int, int]] = []

    def below(left: list[int], rank: int, step: int) -> None:
        width = factorial(len(left) - 1)
        for digit, letter in enumerate(left):
            begin = rank + digit * width
            if mask >> letter & 1:
                found.append((step, begin, begin + width))
            elif len(left) > 1:
                below(left[:digit] + left[digit + 1:], begin, step + 1)
    below(list(range(n)), 0, 1)
    joined: list[tuple[int, int, int]] = []
    for step, begin, end in sorted(found):
        if joined and joined[-1][0] == step and joined[-1][2] == begin:
            joined[-1] = (step, joined[-1][1], end)
        else:
            joined.append((step, begin, end))
    return joined


def interactions(counts: DataFrame, filters: Sequence[str] = FILTERS, measures: Sequence[str] = ("documents", "good", "toxic")) -> DataFrame:
    """One row per part, order and step from counts (part, mask, measures): the filter there and what it does.

    ``removed_<measure>`` at this step, ``kept`` after it, ``redundant`` (fails
    the filter, removed before), ``unique_fails`` (fails nothing else) and
    ``shapley`` (the filter's removals over all orders) of the first measure. A
    part has as many rows as there are orders and steps; parts are shared out
    over the cluster, and the table of intervals depends on the filters only.
    """
    n, orders, first = len(filters), factorial(len(filters)), measures[0]
    spark = counts.sparkSession
    ends = [(mask, step, at, sign) for mask in range(1, 1 << n) for step, begin, end in removal_intervals(mask, n)
            for at, sign in ((begin, 1), (end, -1)) if at < orders]
    marks = F.broadcast(spark.createDataFrame(ends, "mask int, step int, rank int, sign int"))
    order_of = F.broadcast(spark.createDataFrame(
        [(rank, "".join(order)) for rank, order in enumerate(permutations(filters))], "rank int, filter_order string"))
    differences = counts.join(marks, "mask").select("part", "step", "rank", *[(F.col("sign") * F.col(m)).alias(m) for m in measures])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col(first)).otherwise(0)) for i in range(n)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col(first)).otherwise(0)) for i in range(n)]
    totals = counts.groupBy("part").agg(F.sum(first).alias("all"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = totals.select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")).select(
        "part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), *[F.lit(0).cast("long").alias(m) for m in measures])
    along = Window.partitionBy("part", "step").orderBy("rank")
    removed = differences.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in measures]).select(
        "part", "step", "rank", *[F.sum(m).over(along).alias(f"removed_{m}") for m in measures])
    named = removed.join(order_of, "rank").withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    upto = Window.partitionBy("part", "rank").orderBy("step")
    every = Window.partitionBy("part", "filter")
    gone = f"removed_{first}"
    summed = named.withColumns({"gone": F.sum(gone).over(upto), "shapley": F.sum(gone).over(every)})
    at = F.instr(F.lit("".join(filters)), F.col("filter")) - 1
    return summed.join(totals, "part").select(
        "part", "filter_order", "step", "filter", (F.col("all") - F.col("gone")).alias("kept"), *[f"removed_{m}" for m in measures],
        (F.get("fails", at) - F.col(gone)).alias("redundant"), F.get("alone", at).alias("unique_fails"), "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``docs`` per source; an empty table has no parts and gives no rows."""
    return interactions(land(failures(docs, labels), "audit-counts"))
