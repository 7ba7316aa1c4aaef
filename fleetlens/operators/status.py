"""Named status reports: fixed selections of status views, settings and metrics.

``by`` names the fleet keys (server, snapshot) that are carried along.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import names, with_defaults
from .filters import (
    CACHE_SETTINGS, CHECKPOINTS, LOG_CACHE_METRICS, REPLICA_METRICS, REPLICATION_FILTER_DEFAULTS, REPLICATION_SENDERS,
    SERVER_LIMIT_SETTINGS, SOURCE_SETTINGS, TRANSACTION_ID_SETTINGS, TRANSACTION_SETS, describe_metrics, pick_settings,
    project_snapshot,
)

Keys = Iterable[str] | None


def replication_senders(view: DataFrame, by: Keys = None) -> DataFrame:
    """Where each standby stands: positions sent, written, flushed and replayed, and the lag of each step."""
    return project_snapshot(view, REPLICATION_SENDERS, by)


def checkpoints(view: DataFrame, by: Keys = None) -> DataFrame:
    """Checkpoints by cause, time spent on them and buffers written by each process."""
    return project_snapshot(view, CHECKPOINTS, by)


def _default_channel(replicas: DataFrame) -> DataFrame:
    return replicas.filter(F.col("channel_name") == "")


def transaction_sets(replicas: DataFrame, by: Keys = None) -> DataFrame:
    """Transactions received and executed on the default channel."""
    return project_snapshot(_default_channel(replicas), TRANSACTION_SETS, by)


def replication_filters(replicas: DataFrame, by: Keys = None) -> DataFrame:
    """Filters of the default channel; one that is not set says so."""
    known = with_defaults(_default_channel(replicas), REPLICATION_FILTER_DEFAULTS)
    return known.select(*names(by), *REPLICATION_FILTER_DEFAULTS)


def source_settings(settings: DataFrame, by: Keys = None, ordered: bool = True) -> DataFrame:
    """Settings of a server that others replicate from."""
    return pick_settings(settings, SOURCE_SETTINGS, by=by, ordered=ordered)


def transaction_id_settings(settings: DataFrame, by: Keys = None, ordered: bool = True) -> DataFrame:
    """Settings and state of transaction ids."""
    return pick_settings(settings, TRANSACTION_ID_SETTINGS, by=by, ordered=ordered)


def server_limits(settings: DataFrame, by: Keys = None) -> DataFrame:
    """Memory, thread and time limits, one column each."""
    return pick_settings(settings, SERVER_LIMIT_SETTINGS, wide=True, by=by)


def cache_settings(settings: DataFrame, by: Keys = None, ordered: bool = True) -> DataFrame:
    """Settings of a cache server that matter most."""
    return pick_settings(settings, CACHE_SETTINGS, by=by, ordered=ordered)


def log_cache_metrics(status: DataFrame, by: Keys = None) -> DataFrame:
    """Use of the log cache, each metric with what it means."""
    return describe_metrics(status, LOG_CACHE_METRICS).select(*names(by), "name", "value", "description")


def replica_metrics(status: DataFrame, by: Keys = None) -> DataFrame:
    """State of a replica's threads, each metric with what it means."""
    return describe_metrics(status, REPLICA_METRICS).select(*names(by), "name", "value", "description")
