"""Running a stream over what is there and landing its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..workspace import new_dir


def land(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> None:
    """Append a stream to a table exactly once; the checkpoint makes a restart resume."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start(path)
    )
    query.awaitTermination()


def land_available(stream: DataFrame, label: str) -> DataFrame:
    """Run over the data available now and read the landed rows back."""
    root = new_dir(stream.sparkSession, label)
    land(stream, f"{root}/table", f"{root}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/table")
