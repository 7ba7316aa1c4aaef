"""Comparisons of a row with its neighbours in time or sequence."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times
from ..functions.columns import names
from .chunks import CHUNK_ROWS, range_of, running, with_next, with_previous


def maintenance_plan(triage: DataFrame, budget: float, estimate: Column, by: Iterable[str] | None,
                     tie: Sequence[str] = (), chunk: Column | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Items in order of priority that start while the time used before them is below the budget.

    A server with more than ``rows`` items is cut along the whole order, ``tie`` included.
    """
    work = triage.filter(F.col("operation") != "NONE").withColumn("estimated", estimate)
    order = ["priority", "-fragmentation_percent", "-page_count", *tie]
    timed = running(work, by, order, chunk, sums={"elapsed_before": F.col("estimated")}, before=True, rows=rows)
    return timed.filter(F.col("elapsed_before") < budget)


def counter_rate(df: DataFrame, by: Iterable[str], ts: str, counters: Sequence[str], tie: Sequence[str] = (),
                 chunk: Column | None = None, width: float | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Change and rate per second of each counter since the snapshot before.

    A counter that fell was reset: its change and rate are NULL and
    ``<counter>_reset`` is true.
    """
    pairs = with_previous(df, by, [ts, *tie], [ts, *counters], chunk, width=width, rows=rows)
    gap = times.elapsed(F.col(f"prev.{ts}"), ts, "exact")
    out = pairs.withColumn("elapsed_seconds", gap)
    for name in counters:
        change = F.col(name) - F.col(f"prev.{name}")
        out = out.withColumns({
            f"{name}_reset": F.coalesce(change < 0, F.lit(False)),
            f"{name}_delta": F.when(change >= 0, change),
            f"{name}_rate": F.when(change >= 0, F.try_divide(change.cast("double"), F.col("elapsed_seconds"))),
        })
    return out.drop("prev")


def size_growth(df: DataFrame, by: Iterable[str], ts: str, sizes: Sequence[str], tie: Sequence[str] = (),
                chunk: Column | None = None, width: float | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Growth of each size since the snapshot before and per day; sizes may shrink."""
    pairs = with_previous(df, by, [ts, *tie], [ts, *sizes], chunk, width=width, rows=rows)
    days = times.elapsed(F.col(f"prev.{ts}"), ts, "exact") / 86400.0
    out = pairs
    for name in sizes:
        change = F.col(name) - F.col(f"prev.{name}")
        out = out.withColumns({f"{name}_growth": change, f"{name}_per_day": F.try_divide(change.cast("double"), days)})
    return out.drop("prev")


def ltr_keep(backups: DataFrame, as_of: times.Instant, weeks: int = 12, months: int = 12, years: int = 5,
             by: Iterable[str] = ("database",), ts: str = "created", key: str = "backup_id") -> DataFrame:
    """Backups kept by long-term retention: first of a week, month or year within the limits.

    The first backup of each calendar cell (week within month) is found by a
    map-side combined minimum; only those few rows per database can be kept.
    """
    keys = names(by)
    end = times.instant(as_of)
    when = F.col(ts).cast("timestamp")
    cells = backups.filter(F.col(ts) <= times.instant_like(backups, ts, as_of)).groupBy(
        *keys, F.date_trunc("week", when).alias("week"), F.date_trunc("month", when).alias("month"),
    ).agg(F.min(F.struct(F.col(ts).alias("at"), F.col(key).alias("id"))).alias("first"))
    cells = cells.withColumn("year", F.date_trunc("year", "month"))

    def leads(period: str) -> Column:
        return F.row_number().over(Window.partitionBy(*keys, period).orderBy("first")) == 1

    at = F.col("first.at").cast("timestamp")
    flagged = cells.withColumns({
        "weekly": leads("week") & (at >= end - F.make_dt_interval(days=F.lit(7 * weeks))),
        "monthly": leads("month") & (at >= end - F.make_ym_interval(F.lit(0), F.lit(months))),
        "yearly": leads("year") & (at >= end - F.make_ym_interval(F.lit(years))),
    })
    return flagged.filter(F.col("weekly") | F.col("monthly") | F.col("yearly")).select(
        *keys, F.col("first.id").alias(key), F.col("first.at").alias(ts), "weekly", "monthly", "yearly")


def sequence_gaps(df: DataFrame, by: Iterable[str], seq: str, width: int = 1_000_000) -> DataFrame:
    """Missing runs of numbers per source: what was received but not applied.

    Repeated numbers count once and NULL is no number, so a range of ``width``
    numbers is at most ``width`` rows.
    """
    numbers = df.select(*names(by), seq).filter(F.col(seq).isNotNull()).distinct()
    pairs = with_next(numbers, by, [seq], [seq], range_of(seq, width))
    after = F.col(f"next.{seq}")
    return pairs.filter(after > F.col(seq) + 1).select(
        *names(by), (F.col(seq) + 1).alias("gap_from"), (after - 1).alias("gap_to"),
        (after - F.col(seq) - 1).alias("missing"))


def run_intervals(reports: DataFrame, by: Iterable[str], start: str = "start", end: str = "finish",
                  tie: Sequence[str] = (), chunk: Column | None = None, width: float | None = None,
                  rows: int = CHUNK_ROWS) -> DataFrame:
    """Duration of each run and seconds since the start of the run before."""
    pairs = with_previous(reports, by, [start, *tie], [start], chunk, width=width, rows=rows)
    return (
        pairs.withColumn("duration_seconds", times.elapsed(start, end))
        .withColumn("interval_seconds", times.elapsed(F.col(f"prev.{start}"), start)).drop("prev")
    )
