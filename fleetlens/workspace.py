"""Where jobs put tables they write on the way: the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

T = TypeVar("T")

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_passing: ContextVar[tuple[list[str], ...]] = ContextVar("passing", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session's settings, or by ``setCheckpointDir`` where they name none."""
    named = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
    return named.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, so that no run meets another's files."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for passed in _passing.get():
        passed.append(path)
    return path


@contextmanager
def passing_dirs() -> Iterator[list[str]]:
    """The paths that ``new_dir`` gives out to this thread meanwhile, in order."""
    paths: list[str] = []
    before = _passing.set((*_passing.get(), paths))
    try:
        yield paths
    finally:
        _passing.reset(before)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``new_dir`` named, if it is there, through the file system Spark wrote it with."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def observed(metrics: Observation) -> dict[str, object]:
    """Metrics counted by a finished write; none where the optimizer found the plan empty and dropped them."""
    try:
        return metrics.get
    except Py4JJavaError:
        return {}


def side_by_side(actions: Sequence[Callable[[], T]], jobs: int = 4) -> list[T]:
    """Run several Spark actions at a time, so that small tables do not leave the cluster idle."""
    with ThreadPoolExecutor(max_workers=jobs) as pool:
        return list(pool.map(lambda action: action(), actions))
