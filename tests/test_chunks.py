"""Chunked scans equal plain windows, whatever the skew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window, functions as F

from fleetlens.operators import chunks


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
        value = None if rng.random() < 0.05 else rng.randrange(1000)
        data.append((key, rng.randrange(500), i, value))
    return spark.createDataFrame(data, "k string, t long, id long, v long").cache()


def plain(keys=("k",)):
    return Window.partitionBy(*keys).orderBy("t", "id")


@pytest.mark.parametrize("width", [1, 7, 100, 10000])
def test_neighbours(series, rows, width):
    chunk = chunks.range_of("t", width)
    back = chunks.with_previous(series, ["k"], ["t", "id"], ["id", "v"], chunk)
    assert rows(back, "id", "prev.id", "prev.v") == rows(
        series.select("id", F.lag("id").over(plain()).alias("p"), F.lag("v").over(plain()).alias("pv")))
    ahead = chunks.with_next(series, ["k"], ["t", "id"], ["id"], chunk)
    assert rows(ahead, "id", "next.id") == rows(series.select("id", F.lead("id").over(plain()).alias("n")))


@pytest.mark.parametrize("width", [1, 7, 1000, chunks.DAY, 1e9])
def test_any_width_of_time_gives_the_same_answer(series, rows, width):
    timed = series.withColumn("ts", F.when(F.col("id") % 10 > 0, F.timestamp_seconds(F.col("t") * 700)))
    order = Window.orderBy("ts", "id")
    for keys, window in ((["k"], Window.partitionBy("k").orderBy("ts", "id")), ([], order)):
        back = chunks.with_previous(timed, keys, ["ts", "id"], ["id"], width=width)
        assert rows(back, "id", "prev.id") == rows(timed.select("id", F.lag("id").over(window).alias("p")))


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(5000).select(F.lit(None).cast("string").alias("k"), F.lit(7).alias("ts"), "id")
    dealt = df.select(chunks._spread(df, ["k"], chunks.time_chunk("ts")).alias("chunk"))
    assert dealt.distinct().count() > 4000


def test_running_refuses_an_unknown_chunk(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, t long")
    with pytest.raises(Exception, match="chunk"):
        chunks.running(df, ["k"], ["t"], chunks.range_of("t", 10), {"s": F.lit(1)}).collect()


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("keys", [["k"], []])
def test_running(series, rows, before, keys):
    end = -1 if before else Window.currentRow
    frame = plain(keys).rowsBetween(Window.unboundedPreceding, end)
    got = chunks.running(series, keys, ["t", "id"], chunks.range_of("t", 13), {"s": F.col("v")}, {"m": F.col("v")}, before)
    expected = series.select("id", F.coalesce(F.sum("v").over(frame), F.lit(0)).alias("s"), F.max("v").over(frame).alias("m"))
    assert rows(got, "id", "s", "m") == rows(expected)


def test_null_key_has_no_predecessor(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 2)], "k string, t long")
    got = chunks.with_previous(df, ["k"], ["t"], ["t"], chunks.range_of("t", 10))
    assert {(r.k, r.t, r.prev.t if r.prev else None) for r in got.collect()} == {
        (None, 1, None), (None, 2, None), ("a", 1, None), ("a", 2, 1)}


def hot(spark, n=30_000):
    """Half of all rows on one key and one instant, told apart by their ids alone."""
    ident = F.col("id")
    return spark.range(n).select(F.when(ident % 2 == 0, 0).when(ident % 50 == 1, None).otherwise(ident % 37 + 1).alias("k"),
                                 F.when(ident % 2 == 0, F.lit("2024-01-01").cast("timestamp"))
                                 .when(ident % 11 != 0, F.timestamp_seconds(ident * 7919 % 10_007)).alias("ts"), "id", (ident * 31 % 101).alias("v"))


@pytest.mark.parametrize("limit", [50, 700, 1_000_000])
def test_sampled_cuts_equal_a_plain_window(spark, rows, limit):
    df = hot(spark, 8000)
    w = Window.partitionBy("k").orderBy("ts", "id")
    known = F.col("k").isNotNull()
    plain = df.select("*", F.when(known, F.lag("id").over(w)).alias("p"), F.when(known, F.lead("v").over(w)).alias("n"),
                      F.when(known, F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1))).alias("s"))
    back = chunks.with_previous(df, ["k"], ["ts", "id"], ["id"], rows=limit)
    ahead = chunks.with_next(df, ["k"], ["ts", "id"], ["v"], rows=limit)
    total = chunks.running(df, ["k"], ["ts", "id"], sums={"s": F.col("v")}, before=True, rows=limit)
    assert rows(back.select("id", "prev.id")) == rows(plain, "id", "p")
    assert rows(ahead.select("id", "next.v")) == rows(plain, "id", "n")
    assert rows(total.select("id", "s")) == rows(plain.select("id", F.when(known, F.coalesce("s", F.lit(0)))))


def test_sampled_cuts_downwards_and_over_all_rows(spark, rows):
    df = hot(spark, 6000).withColumn("x", F.when(F.col("id") % 13 == 0, float("nan")).when(F.col("id") % 7 != 0, (F.col("v") / 3).cast("double")))
    w = Window.orderBy(F.desc("x"), F.asc("ts"), F.desc("id"))
    plain = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"), F.max("v").over(
        w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))
    got = chunks.running(df, None, ["-x", "ts", "-id"], sums={"s": F.col("v")}, maxima={"m": F.col("v")}, rows=300)
    assert rows(got, "id", "s", "m") == rows(plain)


def test_a_busy_second_is_cut_evenly(spark):
    """No chunk of a key with half of all rows, all at one instant, is much larger than the others."""
    data, keys = chunks._prepared(hot(spark), ["k"])
    whole, bordered = chunks._cut(data, keys, ["ts", "id"], 500)
    sizes = sorted(r["count"] for r in bordered.filter("k = 0").groupBy(chunks._CHUNK).count().collect())
    assert len(sizes) >= 20 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    assert whole.count() == 30_000


def test_rows_that_tie_in_all_that_orders_them_are_cut_too(spark):
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(5).alias("t"), "id")
    data, keys = chunks._prepared(df, ["k"])
    _, bordered = chunks._cut(data, keys, ["t"], 1000)
    sizes = sorted(r["count"] for r in bordered.groupBy(chunks._CHUNK).count().collect())
    assert len(sizes) >= 15 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    back = chunks.with_previous(df, ["k"], ["t"], ["id"], rows=1000)
    assert back.filter("prev is null").count() == 1 and back.select("prev.id").distinct().count() == 20_000


def test_splitters_are_bounded(spark):
    data, keys = chunks._prepared(spark.range(40_000).select((F.col("id") % 400).alias("k"), "id"), ["k"])
    found = chunks.splitters(data, keys, F.struct("id"), rows=10, most=16).collect()
    assert len(found) <= 16 and sum(len(r._splits) for r in found) <= 64


def test_no_row_carries_all_splitters(spark, monkeypatch):
    """Splitters are looked up in a tree: a node holds few however many there are, and the chunk is their count."""
    monkeypatch.setattr(chunks, "FAN", 4)
    df = spark.range(4000).select(F.when(F.col("id") % 5 != 0, F.lit("a")).when(F.col("id") % 2 == 0, F.lit("b")).alias("k"), ((F.col("id") * 37) % 501).alias("t"), "id")
    data, keys = chunks._prepared(df, ["k"])
    place = chunks._place(data, ["t", "id"])
    splits = chunks.splitters(data, keys, place, rows=40)
    held = [r.n for r in chunks._tree(splits, keys).select(F.size(chunks._SPLITS).alias("n")).collect()]
    assert splits.select(F.max(F.size(chunks._SPLITS))).first()[0] > 50 and max(held) <= 8
    whole, bordered = chunks._cut(data, keys, ["t", "id"], 40)
    reached = F.size(F.filter(chunks._SPLITS, lambda s: s <= place))
    for got in (whole.filter("k is not null"), bordered):
        wrong = got.join(splits, keys).filter(F.col(chunks._CHUNK) != reached)
        assert wrong.isEmpty() and got.select(chunks._CHUNK).distinct().count() > 50
