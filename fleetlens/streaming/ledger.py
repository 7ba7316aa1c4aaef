"""Streams landed batch by batch, with a ledger of what is complete.

Each batch writes a folder of its own, named by the stream's generation and the
batch number, and is entered in the ledger afterwards. Readers take the folders
that the ledger names, so a batch is visible as a whole or not at all, and a
batch that runs again replaces its folder. A generation is a token kept in the
checkpoint: a stream that lost its checkpoint starts a new one, as its batch
numbers begin anew and mean other rows.

    path/rows/generation=../batch=..    rows, or sums per window
    path/late/generation=../batch=..    rows that came too late
    path/ledger/generation=../batch=..  one row a batch
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import names
from ..functions.numbers import ratio
from ..sources.logs import parse_logs
from ..workspace import observed

LEDGER = "batch_rows long, late_rows long, newest timestamp, entered timestamp, generation string, batch long"
AVAILABLE = {"availableNow": True}


def generation_of(spark: SparkSession, checkpoint: str) -> str:
    """The token of a checkpoint, made when the checkpoint has none."""
    path = f"{checkpoint}/generation"
    spark.createDataFrame([(uuid.uuid4().hex,)], "token string").coalesce(1).write.mode("ignore").parquet(path)
    return spark.read.schema("token string").parquet(path).first().token


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per complete batch; empty before the first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def _folder(path: str, kind: str, generation: str, batch: int) -> str:
    return f"{path}/{kind}/generation={generation}/batch={batch}"


def enter(spark: SparkSession, path: str, generation: str, batch: int, rows: int, late: int, newest: dt.datetime | None) -> None:
    """Make a batch visible. An entry is one file, so it is there or not."""
    row = spark.createDataFrame([(rows, late, newest)], "batch_rows long, late_rows long, newest timestamp")
    row.withColumn("entered", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(_folder(path, "ledger", generation, batch))


def _read(spark: SparkSession, path: str, kind: str, schema: StructType, entries: DataFrame) -> DataFrame:
    named = StructType(schema.fields).add("generation", "string").add("batch", "long")
    return spark.read.schema(named).parquet(f"{path}/{kind}").join(entries.select("generation", "batch"), ["generation", "batch"], "left_semi")


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], trigger: dict | None) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or AVAILABLE)).start()
    query.awaitTermination()


def land_keyed(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], trigger: dict | None = None) -> None:
    """Append a stream so that each key is there once, whatever was killed or lost.

    Repeats within a batch leave one row. A batch that was written but not
    entered is written again. After the loss of a checkpoint the source comes
    anew; keys that older generations hold are left out, and what they hold
    stays, also where the source has forgotten it. While the generation is the
    only one, no batch is compared with the table. Repeats across batches of one
    generation are for ``stream_reports`` to drop, within its watermark.
    """
    spark = stream.sparkSession
    generation = generation_of(spark, checkpoint)

    def each(batch: DataFrame, number: int) -> None:
        rows, older = batch.dropDuplicates(list(keys)), ledger(spark, path).filter(F.col("generation") != generation)
        if not older.isEmpty():
            same = reduce(lambda a, b: a & b, [F.col(f"_was.{key}").eqNullSafe(F.col(f"_is.{key}")) for key in keys])
            rows = rows.alias("_is").join(_read(spark, path, "rows", batch.schema, older).alias("_was"), same, "left_anti")
        count = Observation()
        rows.observe(count, F.count("*").alias("n")).write.mode("overwrite").parquet(_folder(path, "rows", generation, number))
        enter(spark, path, generation, number, observed(count).get("n", 0), 0, None)
    _run(stream, checkpoint, each, trigger)


def read_keyed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all complete batches."""
    return _read(spark, path, "rows", schema, ledger(spark, path)).select(*schema.names)


def land_windows(stream: DataFrame, path: str, checkpoint: str, delay: str, keys: Iterable[str], ts: str, sums: Mapping[str, Column],
                 width: str = "1 hour", trigger: dict | None = None) -> None:
    """Sums per key and time window, and the rows that came after their window was closed.

    The watermark of a batch is the newest instant of the batches before it, as
    the ledger tells, less ``delay``: a batch that runs again has the same one.
    A row whose window ends at or before it goes to the late rows as it came;
    all others are added up, one row per key, window and batch. A row without
    an instant has no window and is late. So late rows and counted ones are
    together the input. A window's batches are summed up when they are read.
    """
    spark, by = stream.sparkSession, names(keys)
    generation = generation_of(spark, checkpoint)

    def each(batch: DataFrame, number: int) -> None:
        before = ledger(spark, path).filter((F.col("generation") == generation) & (F.col("batch") < number))
        mark = before.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("mark")).first().mark
        seen = Observation()
        timed = batch.withColumn("_ts", F.col(ts).cast("timestamp"))
        late = F.col("_ts").isNull() | F.coalesce(F.col("_w.end") <= F.lit(mark).cast("timestamp"), F.lit(False))
        dated = timed.filter("_ts is not null").withColumn("_w", F.window("_ts", width))
        undated = timed.filter("_ts is null").withColumn("_w", F.lit(None).cast(dated.schema["_w"].dataType))
        marked = dated.unionByName(undated).withColumn("_late", late)
        told = marked.observe(seen, F.count("*").alias("n"), F.count_if("_late").alias("late"), F.max("_ts").alias("newest"))
        told.filter("_late").select(*batch.columns).write.mode("overwrite").parquet(_folder(path, "late", generation, number))
        marked.filter("not _late").groupBy(*by, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).agg(
            *[F.sum(col).alias(name) for name, col in sums.items()]).write.mode("overwrite").parquet(_folder(path, "rows", generation, number))
        found = observed(seen)
        enter(spark, path, generation, number, found.get("n", 0), found.get("late", 0), found.get("newest"))
    _run(stream, checkpoint, each, trigger)


def _latest(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of the generation entered last: after a lost checkpoint, windows are counted from the source anew."""
    entries = ledger(spark, path)
    last = F.max_by("generation", "entered").over(Window.partitionBy(F.lit(0)))
    return entries.withColumn("_last", last).filter("generation = _last")


def read_windows(spark: SparkSession, path: str, schema: str, keys: Iterable[str], sums: Sequence[str], delay: str, closed: bool = True) -> DataFrame:
    """The sums of each key and window: of closed windows, or of all. ``schema`` gives the types of keys and sums."""
    entries = _latest(spark, path)
    kinds = StructType.fromDDL(f"{schema}, window_start timestamp, window_end timestamp")
    total = _read(spark, path, "rows", kinds, entries).groupBy(*names(keys), "window_start", "window_end").agg(*[F.sum(s).alias(s) for s in sums])
    if not closed:
        return total
    return total.filter(F.col("window_end") <= entries.agg(F.max("newest") - F.expr(f"INTERVAL {delay}")).scalar())


def read_late(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows that came too late, as they came."""
    return _read(spark, path, "late", schema, _latest(spark, path)).select(*schema.names)


def land_hourly(stream: DataFrame, path: str, checkpoint: str, delay: str, keys: Iterable[str] = ("metric",), ts: str = "ts",
                value: str = "value", width: str = "1 hour") -> None:
    """Hourly metrics with a table of late rows."""
    land_windows(stream, path, checkpoint, delay, keys, ts, {
        "total": F.col(value), "points": F.col(value).isNotNull().cast("long")}, width)


def read_hourly(spark: SparkSession, path: str, delay: str, keys: Mapping[str, str], total: str = "double", closed: bool = True) -> DataFrame:
    """Averages per key (with its type) and window; ``total`` is the type of the sum of values."""
    kinds = ", ".join(f"`{key}` {kind}" for key, kind in keys.items())
    sums = read_windows(spark, path, f"{kinds}, total {total}, points long", list(keys), ["total", "points"], delay, closed)
    return sums.select(*keys, "window_start", "window_end", ratio("total", "points").alias("average"))


def land_log_errors(lines: DataFrame, path: str, checkpoint: str, delay: str, width: str = "1 hour", source: str = "path") -> None:
    """Error lines per log and window with a table of late ones."""
    errors = parse_logs(lines, source).filter(F.col("level") == "ERROR")
    land_windows(errors, path, checkpoint, delay, ["source"], "ts", {"errors": F.lit(1).cast("long")}, width)


def read_log_errors(spark: SparkSession, path: str, delay: str, closed: bool = True) -> DataFrame:
    return read_windows(spark, path, "source string, errors long", ["source"], ["errors"], delay, closed)
