"""Job tracker with a time-out, as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.movement import TERMINAL

PARTIAL = "started timestamp, last_seen timestamp, ended timestamp, outcome string"
OUTPUT = "started timestamp, ended timestamp, status string"
STATE = "started timestamp, ended timestamp, outcome string, done boolean"


def combine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per job and Arrow batch: first event, last event, first terminal state.

    This is the map side of the tracker, so a busy job reaches its task as a
    few rows per input partition.
    """
    for batch in batches:
        if batch.empty:
            continue
        grouped = batch.groupby("job_id")["ts"].agg(started="min", last_seen="max")
        ended = batch[batch["state"].isin(TERMINAL)].sort_values(["ts", "state"]).drop_duplicates("job_id").set_index("job_id")
        grouped["ended"] = ended["ts"]
        grouped["outcome"] = ended["state"]
        grouped["outcome"] = grouped["outcome"].astype(object).where(grouped["outcome"].notna(), None)
        yield grouped.reset_index()[["job_id", "started", "last_seen", "ended", "outcome"]]


class JobTracker(StatefulProcessor):
    """Emits each job once: with its first terminal state, or as timed out.

    A job whose time is up stays known as closed for ``remember_seconds`` more,
    so that events that come after do not start it anew.
    """

    def __init__(self, timeout_seconds: float, remember_seconds: float):
        self.limit = pd.Timedelta(seconds=timeout_seconds)
        self.remember = int(remember_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started = ended = outcome = None
        done = False
        if self.job.exists():
            started, ended, outcome, done = self.job.get()
        first_seen = started
        for part in rows:
            for row in part.itertuples(index=False):
                started = row.started if started is None else min(started, row.started)
                if pd.notna(row.ended) and (ended is None or row.ended < ended):
                    ended, outcome = row.ended, row.outcome
        if first_seen is None or started < first_seen:
            self.handle.registerTimer(self._due(started))
        if not done and ended is not None:
            done = True
            yield self._row(key, started, ended, outcome)
        self.job.update((started, ended, outcome, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        started, ended, outcome, done = self.job.get()
        expiry, forget = expiredTimerInfo.getExpiryTimeInMs(), self._due(started) + self.remember
        if expiry < self._due(started):
            return  # set by an earlier run of this job
        if expiry >= forget:
            self.job.clear()
            return
        self.handle.registerTimer(forget)
        self.job.update((started, ended, outcome, True))
        if not done:
            yield self._row(key, started, None, None)

    def close(self) -> None:
        pass

    def _due(self, started) -> int:
        return int((pd.Timestamp(started) + self.limit).timestamp() * 1000)

    def _row(self, key, started, ended, outcome) -> pd.DataFrame:
        late = ended is None or pd.Timestamp(ended) - pd.Timestamp(started) > self.limit
        status = "timeout" if late else {"SUCCESS": "success", "FAILED": "failed"}[outcome]
        return pd.DataFrame({
            "job_id": [key[0]], "started": [pd.Timestamp(started)],
            "ended": pd.Series([None if late else pd.Timestamp(ended)], dtype="datetime64[ns]"), "status": [status]})


def stream_job_status(stream: DataFrame, timeout_seconds: float, watermark: str, remember_seconds: float = 7 * 86400.0) -> DataFrame:
    """Outcome of every job (``job_id, ts, state``) once it is known or its time is up.

    One row per job, however its events fall into batches. ``job_id`` may be of
    any type that can be a key. An event more than ``remember_seconds`` after
    the time-out counts as a new job; state is kept that long.
    """
    kind = stream.schema["job_id"].dataType.simpleString()
    slim = stream.select("job_id", F.col("ts").cast("timestamp").alias("ts"), "state")
    partial = slim.mapInPandas(combine_batches, f"job_id {kind}, {PARTIAL}").withWatermark("last_seen", watermark)
    return partial.groupBy("job_id").transformWithStateInPandas(
        JobTracker(timeout_seconds, remember_seconds), f"job_id {kind}, {OUTPUT}", "Append", "EventTime")
