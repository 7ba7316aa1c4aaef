"""Log text: three line layouts, first lines of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordering import latest_n

# The line layouts, as one pattern. A line may be wrapped in terminal colours.
STAMP = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
LINE = (
    rf"^(?:\[({STAMP})\] (?:\[([A-Z]+)\] |(ERROR|WARN|INFO|DEBUG): )?(.*)"
    rf"|({STAMP}),\d{{3}} - ([A-Z]+) - (.*))$"
)
MARK = "\x01"
NOISE = rf"\x1b\[[0-9;]*m|{MARK}"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with the file they come from."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def parse_logs(lines: DataFrame, source: str = "path", text: str = "value") -> DataFrame:
    """Timestamp, level, message and layout of each line.

    One match per line rewrites it as five marked fields, which are then split.
    A line in no layout keeps its text as the message and has neither
    timestamp nor level. ``WARNING`` is reported as ``WARN``.
    """
    clean = F.regexp_replace(F.col(text), NOISE, "")
    marked = F.regexp_replace(clean, LINE, MARK.join(["$1$5", "$2", "$3", "$6", "$4$7"]))
    parts = lines.select(F.col(source).alias("source"), F.split(marked, MARK, 5).alias("p"))
    known = F.size("p") == 5
    stamp, bracketed, colon, dashed, message = (F.get("p", F.lit(i)) for i in range(5))
    level = F.nullif(F.concat(bracketed, colon, dashed), F.lit(""))
    layout = (
        F.when(bracketed != "", F.lit("bracketed")).when(colon != "", F.lit("colon"))
        .when(dashed != "", F.lit("dashed")).when(known, F.lit("plain"))
    )
    return parts.select(
        "source", F.when(known, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss"))).alias("ts"),
        F.when(level == "WARNING", F.lit("WARN")).otherwise(level).alias("level"),
        F.when(known, message).otherwise(stamp).alias("message"), layout.alias("layout"))


def level_counts(parsed: DataFrame) -> DataFrame:
    """Lines per source and level."""
    return parsed.groupBy("source", "level").agg(F.count("*").alias("lines"))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """First lines of every file under ``path``; compressed files too."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"), "value")
    # Line ids only rise within one file block, which is all that is compared here.
    return latest_n(lines.filter(F.col("_block") == 0), ["path"], [F.asc("_line")], n, rank="line_no").select(
        "path", "line_no", "value")
